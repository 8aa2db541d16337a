"""Column functions on text: accent folding, tokens, spelling variants, guards.  All of them stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that the first folding leaves: tilde and cedilla.
KEPT_MARKS = "̧̃"
LATIN = [chr(c) for block in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(*block)]
WORD = "[A-Za-zÀ-ÿ]+"
SPACES = r"(?U)\s+"


@lru_cache(maxsize=2)
def folding(compatible: bool, kept: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Precomposed letters, what each becomes, and those that become several, from the Unicode data."""
    one, to, many = [], [], []
    letters = LATIN + [chr(c) for c in range(0xFB00, 0xFB07)] if compatible else LATIN
    for c in letters:
        apart = unicodedata.normalize("NFKD" if compatible else "NFD", c)
        left = "".join(x for x in apart if not unicodedata.combining(x) or x in kept)
        new = left if compatible else unicodedata.normalize("NFC", left)
        if new == c:
            continue
        if len(new) == 1:
            one.append(c)
            to.append(new)
        else:
            many.append((c, new))
    return "".join(one), "".join(to), tuple(many)


def let(body, **values: Column) -> Column:
    """body of values that are computed once a row: expressions inside a lambda would be computed for each element."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), lambda v: body(*[v[k] for k in values])), 1)


def _fold(x: Column, compatible: bool, kept: str) -> Column:
    """A text of ASCII alone is left as it is, and letters that become several are looked for only where there is one."""
    one, to, many = folding(compatible, kept)
    out = F.translate(x, one, to)
    if many:
        apart = out
        for c, new in many:
            apart = F.replace(apart, F.lit(c), F.lit(new))
        out = F.when(out.rlike("[" + "".join(c for c, _ in many) + "]"), apart).otherwise(out)
    marks = f"[\\p{{Mn}}&&[^{kept}]]" if kept else "\\p{Mn}"
    bare = F.regexp_replace(out, marks, "")
    for mark, letters in zip(KEPT_MARKS, ("nN", "cC"), strict=True) if kept else ():
        for base in letters:
            bare = F.replace(bare, F.lit(base + mark), F.lit(unicodedata.normalize("NFC", base + mark)))
    out = F.when(out.rlike("\\p{Mn}"), bare).otherwise(out)
    return F.when(x.rlike(r"[^\x00-\x7F]"), out).otherwise(x)


def strip_accents(x: Column) -> Column:
    """Letters without accents; tilde and cedilla stay."""
    return _fold(x, False, KEPT_MARKS)


def normalise(x: Column) -> Column:
    """Accents off but for tilde and cedilla, lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(x)), SPACES, " "))


def word_key(x: Column) -> Column:
    """The form under which a word is listed in a dictionary."""
    return F.trim(F.lower(strip_accents(x)))


def fold_all(x: Column) -> Column:
    """Compatibility forms without any mark, lower case; white space stays."""
    return F.lower(_fold(x, True, ""))


def words(x: Column) -> Column:
    """Runs of letters."""
    return F.regexp_extract_all(x, F.lit(WORD), F.lit(0))


def tokens(x: Column) -> Column:
    """What stands between white space; never an empty token."""
    return F.filter(F.split(x, SPACES), lambda w: w != "")


def word_punct(x: Column) -> Column:
    """Words and runs of punctuation."""
    return F.regexp_extract_all(x, F.lit(r"(?U)\w+|[^\w\s]+"), F.lit(0))


def with_spaces(x: Column) -> Column:
    """Tokens and the white space between them, so that joining gives the text back."""
    return F.split(x, r"(?U)(?<=\s)(?=\S)|(?<=\S)(?=\s)")


def spans(x: Column) -> Column:
    """Tokens with the place of their begin and end in the text, from 0."""

    def placed(parts):
        step = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["all"], F.array(F.struct(p.alias("token"), acc["at"].alias("start"), (acc["at"] + F.length(p)).alias("end")))).alias("all"))
        none = F.array().cast("array<struct<token:string,start:int,end:int>>")
        return F.filter(F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("all")), step)["all"], lambda s: ~s["token"].rlike(r"(?U)^\s*$"))

    return let(placed, parts=with_spaces(x))


def wrapped(x: Column, width: int = 12) -> Column:
    """The text as lines of `width` tokens; no lines if it has no token."""

    def cut(t):
        return F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(1), F.size(t), F.lit(width)), lambda i: F.array_join(F.slice(t, i, F.lit(width)), " "))).otherwise(F.array().cast("array<string>"))

    return let(cut, t=tokens(x))


def plain_cedilla(x: Column) -> Column:
    return F.translate(x, "çÇ", "zZ")


EDGE = "A-Za-zÀ-ÿ"


def edges(x: Column) -> tuple[Column, Column, Column]:
    """What stands before the first letter, the core, and what stands after the last letter."""
    outside = lambda c: F.regexp_extract(c, f"^([^{EDGE}]*)", 1)
    before = outside(x)
    after = F.when(before == x, "").otherwise(F.reverse(outside(F.reverse(x))))
    return before, F.substr(x, F.length(before) + 1, F.length(x) - F.length(before) - F.length(after)), after


def variants(word: Column, pair: str, most: int = 5) -> Column:
    """All spellings with either letter of the pair wherever one stands, case kept; the word alone if there are none or
    over `most` such places."""
    low, high = pair.lower(), pair.upper()
    place = f"[{low}{high}]"

    def spelled(found, between):
        def step(acc, i):
            own = F.element_at(found, i)
            choice = F.when(own.isin(list(low)), F.array(*map(F.lit, low))).otherwise(F.array(*map(F.lit, high)))
            return F.flatten(F.transform(acc, lambda a: F.transform(choice, lambda c: F.concat(a, c, F.element_at(between, i + 1)))))

        return F.aggregate(F.sequence(F.lit(1), F.size(found)), F.array(F.element_at(between, 1)), step)

    found = F.regexp_extract_all(word, F.lit(place), F.lit(0))
    return F.when(F.size(found).between(1, most), let(spelled, found=found, between=F.split(word, place))).otherwise(F.array(word))


def same_letters(a: Column, b: Column) -> Column:
    """Whether two strings differ only in punctuation, white space or case."""
    bare = lambda x: F.lower(F.regexp_replace(x, r"(?U)\W+", ""))
    return bare(a) == bare(b)


def guarded(original: Column, candidate: Column, tolerance: int = 0) -> Column:
    """The candidate with status success, or the original where the numbers of words differ by more than the tolerance."""
    blank = F.trim(F.regexp_replace(original, SPACES, " ")) == ""
    ok = F.abs(F.size(tokens(original)) - F.size(tokens(candidate))) <= tolerance
    return F.struct(
        F.when(~blank & ok, candidate).otherwise(original).alias("text"),
        F.when(blank, "empty_input").when(ok, "success").otherwise("word_count_mismatch").alias("status"),
    )


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def without_fences(x: Column) -> Column:
    """An answer without a code fence around it, or else without one pair of quotes around it."""
    x = F.trim(x)
    fence = F.trim(F.regexp_replace(F.regexp_replace(x, r"^```[^\n]*\n?", ""), r"\n?```$", ""))
    return F.when(x.startswith("```"), fence).when(x.rlike(r'^".*"$') & (F.length(x) > 1), F.trim(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x)


def retry_seconds(message: Column, attempt: Column) -> Column:
    """How long to wait after a refusal: the longer of 15 s an attempt and a second over what the message asks for."""
    asked = F.regexp_extract(message, r"retry in (\d+\.?\d*)s", 1)
    return F.greatest(attempt * 15.0, F.coalesce(F.try_to_number(asked, F.lit("999999.999999")).cast("double") + 1.0, F.lit(0.0)))


def snippet(x: Column, start: Column, end: Column, around: int = 50) -> Column:
    """The text around [start, end), line breaks as spaces; positions count from 0."""
    a = F.greatest(start - around, F.lit(0))
    return F.replace(F.substring(x, a + 1, F.least(end + around, F.length(x)) - a), F.lit("\n"), F.lit(" "))


def swapped(x: Column) -> Column:
    """A deterministic misreading: u for v and f for s, and the other way round."""
    return F.translate(x, "uvfsUVFS", "vusfVUSF")
