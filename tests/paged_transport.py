"""A paged API over a folder: as many rows as its file `total` says; some pages fail once."""

import json
import os
import urllib.parse

from corpusflow.sources.fetch import Reply


def get(url):
    q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query))
    folder = urllib.parse.urlsplit(url).path
    n, first, length = int(open(folder + "/total").read()), int(q["offset"]), int(q["length"])
    mark = f"{folder}/seen-{first}-{length}"
    if first % 20 == 10 and not os.path.exists(mark):
        open(mark, "w").close()
        return Reply(429, {"retry-after": "0"})
    rows = [{"i": i, "text": f"row {i}"} for i in range(first, min(n, first + length))]
    return Reply(200, {}, json.dumps({"rows": rows, "total": n}).encode())
