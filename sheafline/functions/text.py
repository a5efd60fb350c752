"""Text functions with the whitespace and letter-case rules of Unicode-aware scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space when trimming and splitting.
SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Fixed value: everything outside printable ASCII is deleted from outline entries.
NOT_PRINTABLE = r"[^\x20-\x7E]"
# Fixed value: tokens are runs of letters and digits.
TOKEN_BREAK = r"[^\p{L}\p{N}]+"
# Fixed value: a sentence ends at one or more of these marks.
SENTENCE = r"[^.!?]+[.!?]*"


SPACES = "".join(
    chr(x)
    for x in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028,
        0x2029, 0x202F, 0x205F, 0x3000,
    )
)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def clean_text(c: Column) -> Column:
    """Trim, collapse white space, then delete non-printables (in that order, no second trim)."""
    collapsed = F.regexp_replace(strip(c), rf"{SPACE_CLASS}+", " ")
    return F.coalesce(F.regexp_replace(collapsed, NOT_PRINTABLE, ""), F.lit(""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"{SPACE_CLASS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def at_most_words(stripped: Column, n: int) -> Column:
    """Whether a stripped text has at most ``n`` words; gives up at the first word beyond."""
    gap, word = f"{SPACE_CLASS}++", f"[^{SPACE_CLASS[1:-1]}]++"
    return (stripped == "") | stripped.rlike(rf"^{word}(?:{gap}{word}){{0,{n - 1}}}+\z")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in text order with repeats."""
    return F.filter(F.split(F.lower(c), TOKEN_BREAK), lambda w: w != "")


def sentences(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def is_upper(c: Column) -> Column:
    """At least one upper-case letter and none of lower or title case."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")


def contains_any(c: Column, needles: list[str]) -> Column:
    """Substring test against each needle (not a word match)."""
    out = F.lit(False)
    for needle in needles:
        out = out | c.contains(needle)
    return out


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | c.startswith(prefix)
    return out


def squared_norm(toks: Column) -> Column:
    """Sum of the squared token counts, in one pass over the sorted tokens."""
    start = F.struct(
        F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("total")
    )

    def step(acc: Column, t: Column) -> Column:
        # One more of a run of r adds (r + 1)^2 - r^2 = 2r + 1.
        run = F.when(acc["prev"] == t, acc["run"]).otherwise(0)
        return F.struct(
            t.alias("prev"), (run + 1).alias("run"), (acc["total"] + 2 * run + 1).alias("total")
        )

    return F.aggregate(F.array_sort(toks), start, step, lambda acc: acc["total"])
