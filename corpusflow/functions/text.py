"""Text functions: Column in, Column out, all evaluated by the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate words and lines, and those that don't print.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
UNPRINTABLE = r"[\x00-\x08\x0b-\x1f\x7f-\x{a0}\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def rstripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+$", "")


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def case_folded(c: Column) -> Column:
    """Text for comparison without case: lower case of the upper case, which joins
    letters such as the German sharp s and its two, and one small sigma."""
    # Without the sigma's step between, the optimizer drops the upper case.
    return F.lower(F.translate(F.upper(c), "\u03a3", "\u03c3"))


def normalized_hash(c: Column) -> Column:
    """SHA-256 (hex) of the lower-cased, collapsed text."""
    return F.sha2(collapsed(F.lower(c)), 256)


def shingles(c: Column, n: int) -> Column:
    """Distinct n-word shingles; none with fewer words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))
    return F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))
        ),
    )[0]


def shingle_hashes(c: Column, n: int) -> Column:
    """A 64-bit number for each place of an n-word shingle; equal shingles have
    equal numbers."""
    words = F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    runs = lambda h: F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, n)))
    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda h: F.when(F.size(h) < n, F.array().cast("array<long>")).otherwise(runs(h)))[0]


def tag(c: Column, name: str) -> Column:
    """The trimmed content of the first <name> element; null if none or empty."""
    return F.nullif(stripped(F.regexp_extract(c, rf"(?is)<{name}>(.*?)</{name}>", 1)), F.lit(""))


def normalize_answer(c: Column) -> Column:
    """Lower case; articles go, then anything but a-z and 0-9 is a space."""
    bare = F.regexp_replace(F.lower(c), r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def token_f1(prediction: Column, answer: Column) -> Column:
    """Harmonic mean of word precision and recall with multiplicity."""
    words = lambda c: F.filter(F.split(normalize_answer(c), " "), lambda w: w != "")
    # The nth occurrence of a word gets its own name, so that a set intersection counts with multiplicity.
    named = lambda x: F.transform(F.array(F.array_sort(x)), lambda s: F.transform(s, lambda w, i: F.concat_ws(" ", w, i - F.array_position(s, w))))[0]

    def score(two: Column) -> Column:
        p, a = two.p, two.a
        either = (F.size(p) == 0) | (F.size(a) == 0)
        # 2PR / (P + R) is twice the common words over all words.
        common = F.size(F.array_intersect(named(p), named(a)))
        return F.when(either, ((F.size(p) == 0) & (F.size(a) == 0)).cast("double")).otherwise(2.0 * common / F.greatest(F.size(p) + F.size(a), F.lit(1)))

    return F.transform(F.array(F.struct(words(prediction).alias("p"), words(answer).alias("a"))), score)[0]


def exact_match(prediction: Column, answer: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(answer)).cast("double")


def normalize_math(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"\.+$", ""), r"\$|\\,| ", "")
    return F.lower(F.regexp_replace(bare, r"^\\boxed\{(.*)\}$", "$1"))


def boxed_answer(c: Column) -> Column:
    """The last brace-free \\boxed{...}, else what follows 'final answer' or
    'answer is' on its line; null if neither."""
    boxes = F.regexp_extract_all(c, F.lit(r"\\boxed\{([^{}]+)\}"), F.lit(1))
    said = F.nullif(F.trim(F.regexp_extract(c, r"(?i)(?:final answer|answer is)\s*[:=]?\s*([^\n]+)", 1)), F.lit(""))
    return F.coalesce(F.try_element_at(boxes, F.lit(-1)), said)


def choice(c: Column, letters: str = r"\p{L}\p{N}_") -> Column:
    """The first of A to E that stands alone, in any case; letters: the
    characters of words, within which it doesn't."""
    # The upper case of a text may have other letters than its own (two for a sharp s), but for these two.
    return F.nullif(F.upper(F.regexp_extract(F.translate(c, "\u0131\u017f", "IS"), rf"(?<![{letters}])([A-Ea-e])(?![{letters}])", 1)), F.lit(""))


# The control tokens of the text protocol.
CONTROL_TOKENS = ("<|pad|>", "<|bos|>", "<|eos|>", "<|problem|>", "<|reasoning|>", "<|answer|>", "<|tool_call|>", "<|end_tool_call|>", "<|tool_result|>", "<|end_tool_result|>", "<|citation|>")


def sanitized(c: Column, tokens=CONTROL_TOKENS, limit: int = 12_000) -> Column:
    """Unprintable characters as spaces, control tokens spaced out, cut to a limit."""
    out = F.regexp_replace(c, UNPRINTABLE, " ")
    for t in tokens:
        out = F.replace(out, F.lit(t), F.lit(f"< | {t[2:-2]} | >"))
    return F.left(out, F.lit(limit))


def source_id(provider: Column, url: Column) -> Column:
    return F.concat(provider, F.lit(":"), F.left(F.sha2(url, 256), F.lit(20)))


def chunked(c: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Sentences and paragraphs packed into chunks of about `size` characters
    by one fold; a chunk begins with the last `overlap` characters of the one
    before. A longer sentence makes strided windows of its own."""
    units = F.filter(F.transform(F.split(F.trim(F.regexp_replace(c, "[ \\t]+", " ")), r"(?<=[.!?])\s+|\n{2,}"), stripped), lambda u: u != "")
    stride = size - overlap
    windows = lambda u: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(u) - overlap - 1, F.lit(0)) / stride).cast("int")), lambda i: F.substring(u, i * stride + 1, F.lit(size)))
    state = lambda done, held: F.struct(done.alias("done"), held.alias("held"))
    closed = lambda s: F.when(s.held == "", s.done).otherwise(F.array_append(s.done, s.held))

    def step(s: Column, u: Column) -> Column:
        fits = (s.held == "") | (F.length(s.held) + 1 + F.length(u) <= size)
        tail = F.right(s.held, F.lit(overlap))
        return (
            F.when(F.length(u) > size, state(F.concat(closed(s), windows(u)), F.lit("")))
            .when(fits, state(s.done, F.ltrim(F.concat(s.held, F.lit(" "), u))))
            .otherwise(state(F.array_append(s.done, s.held), F.ltrim(F.concat(tail, F.lit(" "), u))))
        )

    return F.aggregate(units, state(F.array().cast("array<string>"), F.lit("")), step, closed)


def math_verified(trace: Column, expected: Column) -> Column:
    """Whether a trace's boxed or stated answer equals the expected one."""
    return F.coalesce(normalize_math(boxed_answer(trace)) == normalize_math(expected), F.lit(False))


def fenced_code(response: Column, answer: Column) -> Column:
    """The last fenced block of a response, else the answer."""
    blocks = F.regexp_extract_all(response, F.lit(r"(?is)```(?:python)?\s*(.*?)```"), F.lit(1))
    return F.coalesce(stripped(F.try_element_at(blocks, F.lit(-1))), answer)


def reasoning_document(problem: Column, reasoning: Column, answer: Column) -> Column:
    """The training text of a problem with its reasoning and answer."""
    return F.concat(F.lit("<|problem|>\n"), stripped(problem), F.lit("\n<|reasoning|>\n"), stripped(reasoning), F.lit("\n<|answer|>\n"), stripped(answer))


def without_citations(text: Column, ids: Column) -> Column:
    """text without the literal markers [id] of the given ids, collapsed."""
    return collapsed(F.aggregate(F.coalesce(ids, F.array().cast("array<string>")), text, lambda s, i: F.replace(s, F.concat(F.lit("["), i, F.lit("]")), F.lit(" "))))


def head_and_tail(ids: Column, maximum: Column | int, most: int = 128) -> Column:
    """ids cut to `maximum`: a head of min(most, maximum / 4), the rest from the tail."""
    top = F.greatest(F.lit(maximum) if isinstance(maximum, int) else maximum, F.lit(1)).cast("int")
    head = F.least(F.lit(most), F.floor(top / 4)).cast("int")
    return F.when(F.size(ids) <= top, ids).otherwise(F.concat(F.slice(ids, F.lit(1), head), F.slice(ids, head - top, top - head)))
