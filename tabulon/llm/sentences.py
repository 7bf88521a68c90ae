"""Sentence boundaries across languages and scripts (problem 9).

All of it is SQL expressions on one text column. Decimals, addresses, initials,
abbreviations, paragraph numbers, dots of omission and the inside of quotations are masked
with private-use placeholders of the same length, so offsets never move; the text is cut at
blocks, and each masked block at the terminators of its script; the units are offsets into the
original text, which restores it without further work.

Every unit is an interval of code points; between units there are only blanks, so none of
the text is lost. The only shuffle moves lengths (a few bytes per unit), not text.

Defined results: a null or blank text gives no unit; a text without an empty line is one
block; texts of any length are handled, patterns being possessive or bounded by their block;
repeated documents give their units once for each doc_id; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Placeholders (private use area).
DOT, OPEN, CLOSE, FINAL = "\ue000", "\ue020", "\ue021", "\ue022"

# Abbreviations that never end a sentence when something follows.
ALWAYS = {
    "en": ["v", "No", "Nos", "Mr", "Mrs", "Ms", "Dr", "Prof", "M", "St", "para", "paras", "approx", "Cf", "cf", "ss", "s", "Art", "Arts", "reg", "regs", "Sec", "Secs", "Sched", "QRep", "Rep", "Cr", "p", "pp", "vol", "ed", "Jan", "Feb", "Mar", "Apr", "Aug", "Sept", "Sep", "Oct", "Nov", "Dec", "e.g", "i.e", "viz"],
    "de": ["Dez", "Jan", "Febr", "Feb", "Apr", "Aug", "Sept", "Okt", "Nov", "Nr", "Abs", "Az", "Urt", "Beschl", "vgl", "Vgl", "insb", "gem", "rd", "ca", "bzw", "Mio", "Mrd", "Fa", "Ri", "Vors", "Rn", "Rdnr", "i", "d", "v", "ff", "S", "Art", "Hr", "Fr", "Ziff", "Aufl", "Kl", "sog", "evtl"],
    "fr": ["févr", "fevr", "déc", "janv", "juill", "sept", "oct", "nov", "art", "arts", "al", "prof", "Cass", "c", "cf", "M", "MM", "n", "p", "q"],
    "es": ["núm", "num", "art", "arts", "ap", "mill", "rec", "disp", "adic", "dic", "Sr", "Sra", "Srta", "Dr", "Dra", "D", "Da", "p", "pág", "ene", "feb", "abr", "ago", "sept", "oct", "nov", "Excmo"],
}
# Endings of names and lists that may end a sentence.
MAYBE = ["Ltd", "Inc", "Co", "Corp", "plc", "S.A.R.L", "S.A", "S.L", "Cía", "Cia", "Cie", "etc", "usw", "al", "a.m", "p.m", "u. a", "u.a", "J", "Kr"]
# German words that follow an ordinal.
ORDINAL = "Tag|Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Febr|Apr|Aug|Sept|Okt|Nov|Dez|Senat|Kammer|Abschnitt|Kapitel"

TERM = ".!?。！？।"
_BLANKS = " \t\n\r\x0b\x0c\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u3000\ufeff"
BLANK = f"[{_BLANKS}]"
START = rf"[\p{{Lu}}\p{{Lt}}\p{{Pi}}\p{{Ps}}{OPEN}\"'“„«‘¿¡█¶§]"


def _any(words: list[str]) -> str:
    """One pattern of all words with their capital forms, longer ones in lower case too, branching on the first letter."""
    forms = sorted({x for w in words for x in (w, w[:1].upper() + w[1:], w.upper(), w.lower() if len(w) > 3 else w)}, key=lambda w: (-len(w), w))
    by_first: dict[str, list[str]] = {}
    for w in forms:
        by_first.setdefault(w[0], []).append(w[1:].replace(".", r"\.").replace(" ", r"\s"))
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_first.items()))


_EDGE = r"(?<![\p{L}\p{M}\p{N}.])"
_FOLLOWED = rf"(?={BLANK}++\S)"

#: An empty line ends a block; the cut is zero-width, so the parts keep every character.
CUT = r"(?<=\n)(?=[ \t\r\u00a0\u3000]*+\n)"
#: Quotation pairs, outermost first. One group each.
_inner = lambda a: rf"([^{a}]*+)"
PAIRS = rf'(?=[„“«「『‘"])(?:„{_inner("„“”")}[“”]|“{_inner("“”„")}”|«{_inner("«»")}»|「{_inner("「」")}」|『{_inner("『』")}』|‘([^‘’]*+)’(?!\p{{L}})|"{_inner(chr(34))}")'
#: Dots that end no sentence, each case anchored at its dot:
_DOTS = [
    rf"(?=[^\s{CLOSE}{FINAL})\]”’»])",  # inside numbers, addresses, initials, dots of omission
    rf"(?={BLANK}++[\p{{N}}\p{{Lo}}.])",  # before digits and letters without case
    rf"(?={BLANK}++\p{{Ll}})(?<![\p{{L}}\p{{M}}]{{4}}\.|\d{{4}}\.)",  # before lower case, but for full words and years: text set in lower case
    rf"(?={BLANK}++\p{{Ll}})(?<={_EDGE}(?:{_any(MAYBE)})\.)",
    rf"{_FOLLOWED}(?<={_EDGE}(?:{_any([w for ws in ALWAYS.values() for w in ws])})\.)",  # abbreviations
    rf"(?={BLANK}++(?:[$€£(&/]|Cr\W|KG\b))(?<={_EDGE}(?:[A-Z]\.[A-Z]|{_any(MAYBE)})\.)",  # endings of names that go on
    rf"(?<={_EDGE}(?:[zZ]\.\s?B|[aA]\.\s?D)\.){_FOLLOWED}|(?<={_EDGE}[zZ]\.)(?=\s?B\.)|(?<={_EDGE}[aA]\.)(?=\s?D\.)",
    rf"(?<={_EDGE}U\.)(?=\s?A\.)|(?<={_EDGE}U\.\s?A\.)(?=\s+\p{{Lu}}{{2}})",
    r"(?<=\A\s{0,8}(?:\d{1,5}|[IVX]{1,6}|\p{Lu})\.)(?=\s)",  # paragraph numbers
    rf"(?<=(?<![\p{{L}}\p{{N}}.,])\d{{1,2}}\.)(?iu:(?=\s++(?:{ORDINAL})\b))",  # German ordinals
    rf"(?<=[\u0900-\u097F]\.){_FOLLOWED}",  # sentences of this script end with a danda
    r"(?<=(?<!\.)\.\.\.)",
]
DOTS = rf"\.(?:{'|'.join(_DOTS)})"
#: Zero-width places where a sentence ends, by script: cased letters, Han and kana, Devanagari, Thai.
LATIN = rf"(?=\s)(?<=[.!?)\]{CLOSE}{FINAL}])(?:(?<=[.!?][)\]]?|[.!?]\s?[{CLOSE}{FINAL}][)\]]?)(?=\s++{START})|(?<=[.!?])(?=\s++\p{{Ll}}))"
_NEXT = r"[\p{L}\p{N}\p{Ps}█]"  # after a quotation that closed its sentence: a word, figure, bracket or redaction
HAN = rf"{LATIN}|(?<=[。！？])(?![{CLOSE}{FINAL}）)」』”]|\s*\z)|(?<=[。！？?!][{FINAL}])(?=\s*{_NEXT})"
DEVANAGARI = rf"{LATIN}|(?=\s)(?<=[।?!])(?=\s++\p{{IsDevanagari}})|(?=\s)(?<=[।?!.]\s?{FINAL})(?=\s++{_NEXT})|(?<=।)(?=\s++\S)"
THAI = r"(?=\s)(?<=[\u0e00-\u0e7f])(?=\s++[\u0e00-\u0e7f])"
CLOSED = rf"[{TERM}][)\]」』”’“»\"\s]*\z"


def has(c: Column, chars: str) -> Column:
    out = F.lit(False)
    for x in chars:
        out = out | c.contains(x)
    return out


def quotes_masked(block: Column) -> Column:
    """Quotation marks become OPEN and CLOSE; terminators inside, but for the last, become DOT."""
    marked = F.regexp_replace(block, PAIRS, f"{OPEN}$1$2$3$4$5$6$7{CLOSE}")
    parts = F.split(marked, f"(?<={OPEN})|(?={CLOSE})")  # every second part is a quotation
    inside = lambda s, i: F.when(i % 2 == 1, F.regexp_replace(s, rf"[{TERM}](?!\s*\z)", DOT)).otherwise(s)
    return F.when(has(block, "„“«「『‘\""), F.array_join(F.transform(parts, inside), "")).otherwise(block)


def after_colon(q: Column) -> Column:
    """A quotation after a colon that closes with a terminator closes its sentence: its CLOSE becomes FINAL."""
    final = F.regexp_replace(q, rf"([:：]\s?{OPEN}[^{OPEN}{CLOSE}]*+(?<=[{TERM}]|[{TERM}]\s)){CLOSE}", f"$1{FINAL}")
    return F.when(q.contains(OPEN) & has(q, ":："), final).otherwise(q)


def dots_masked(x: Column) -> Column:
    return F.when(x.contains("."), F.regexp_replace(x, DOTS, DOT)).otherwise(x)


def lengths(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, b, p, n, lead, body): length, outer blanks and body of every piece p of every block b."""
    x = df.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), CUT)).alias("b", "block"))
    block = F.col("block")
    wide = F.length(block) != F.octet_length(block)  # anything but ASCII
    kind = F.when(wide & block.rlike(r"[\u0e00-\u0e7f]"), "thai").when(~F.right(F.btrim(block, F.lit(_BLANKS)), F.lit(8)).rlike(CLOSED), "whole")
    kind = kind.when(wide & has(block, "。！？"), "han").when(wide & block.rlike(r"[\u0900-\u097f]"), "devanagari").otherwise("latin")
    x = x.withColumn("kind", kind)
    x = x.withColumn("m", F.when(F.col("kind").isin("thai", "whole"), block).otherwise(quotes_masked(block))).withColumn("m", after_colon(F.col("m"))).withColumn("m", F.when(F.col("kind").isin("thai", "whole"), F.col("m")).otherwise(dots_masked(F.col("m"))))
    m = F.col("m")
    cut = lambda k, p: (F.col("kind") == k, F.split(m, p))
    pieces = F.when(F.col("kind") == "whole", F.array(m)).when(*cut("latin", LATIN)).when(*cut("han", HAN)).when(*cut("devanagari", DEVANAGARI)).otherwise(F.split(m, THAI))
    x = x.select("key", "b", F.posexplode(pieces).alias("p", "s"))
    x = x.withColumn("h", F.ltrim(F.col("s"), F.lit(_BLANKS)))
    n, rest = F.length("s"), F.length("h")
    return x.select("key", "b", "p", n.alias("n"), (n - rest).alias("lead"), F.length(F.rtrim(F.col("h"), F.lit(_BLANKS))).alias("body"))


def units(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_pos, end_pos): sentence units as code-point offsets, end exclusive."""
    x = lengths(df.filter(F.col(text).isNotNull()), key, text)
    before = F.sum("n").over(W.partitionBy("key").orderBy("b", "p").rowsBetween(W.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) + F.col("lead")
    return x.select(F.col("key").alias(key), start.cast("int").alias("start_pos"), (start + F.col("body")).cast("int").alias("end_pos"), "body").filter("body > 0").drop("body")


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """units with the text of each, taken from the original by its offsets."""
    u = units(df, key, text)
    d = df.select(key, F.col(text).alias("__text"))
    return u.join(d, key).select(key, "start_pos", "end_pos", F.substring("__text", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")).alias("sentence"))
