"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Only SQL expressions: no Python touches a row. A span's place comes from the lengths of the pieces that
split() leaves around the matches of regexp_extract_all(), both of the same Java pattern, so whole texts
of any length are scanned once or twice per kind and nothing is exchanged between tasks. Quantifiers are
possessive where a run can be long: a text of one endless word or number costs linear time and no stack.

Kinds: email, ip, card and phone as proposed and confirmed below are always kept, whatever their score;
iban (mod-97) is kept if its checksum holds, and secret (a long key beside a word such as token) if its
score reaches the threshold. Scores start from the strength of the pattern's own check and gain from
words of the kind within `reach` code points on either side.

Defined results: a null text counts as empty and has no spans; spans of one kind never overlap, those of
different kinds may; equal rows give equal results; an empty table gives no rows; extra columns are kept
by mask() and ignored by find().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, only, table


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a text without this plain pattern has no match
    base: float
    words: str
    least: float = 0.0


LOCAL = "[A-Za-z0-9._%+-]"
#: Characters of an IBAN by its length and country.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(" ".join(IBANS.values()).split())
#: Of a known country, as long as its IBANs are, so that no word behind is taken in; of any other, a run up to the next IBAN of a known one.
IBAN = "|".join(rf"(?:{x.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, x in IBANS.items()) + rf"|(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20(?:{_KNOWN})[0-9]{{2}})\x20?[A-Z0-9]){{11,30}}+"
KINDS = (
    # a match starts at the start of a run, or where the last match ended
    Kind("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.7, r"\b(e-?mail|mail|contact|write|correo|courriel)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.5, r"\b(ip|host|server|address|addr|login)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", "", 0.6, r"\b(card|visa|master|credit|tarjeta|carte|karte)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, r"\b(phone|tel|call|mobile|fax|telefon)\b"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN})(?![A-Za-z0-9])", "", 0.8, r"\b(iban|account|konto|cuenta|compte|bank)\b"),
    Kind("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{32,}+(?![A-Za-z0-9_-])", "", 0.3, r"\b(token|secret|key|api|apikey|password|passwd)\b", 0.6),
)
BASE = KINDS[:4]
REACH = 40
SPAN = "array<struct<kind:int,start:int,end:int,score:double>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    places = F.transform(F.sequence(F.lit(1), n), lambda i: digits.substr(i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    total = F.aggregate(places, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return (n > 0) & (total % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an account number (upper case, no spaces) leaves 1 on division by 97."""
    moved = F.concat(account.substr(F.lit(5), F.length(account)), account.substr(1, 4))
    rest = F.aggregate(
        F.split(moved, ""), F.lit(0), lambda s, c: F.when(c == "", s).when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    )
    return rest == 1


def _holds(kind: str, match: Column) -> Column:
    """The check that a proposed match must pass."""
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & mod97(F.regexp_replace(match, " ", ""))
    return F.lit(True)


def _spans(number: int, kind: Kind, text: Column, pieces: Column, found: Column) -> Column:
    """Confirmed and scored spans of one kind, by start."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match")))).alias("spans"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    placed = F.aggregate(pairs, zero, step, lambda s: s["spans"])
    kept = F.filter(placed, lambda s: _holds(kind.name, s["match"]))

    def scored(s: Column) -> Column:
        left = F.greatest(s["start"] - REACH, F.lit(0))
        near = F.concat(text.substr(left + 1, s["start"] - left), F.lit(" "), text.substr(s["end"] + 1, F.lit(REACH)))
        score = F.lit(kind.base) + F.when(F.lower(near).rlike(kind.words), 0.3).otherwise(0.0)
        return F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    spans = F.transform(kept, scored)
    return F.filter(spans, lambda s: s["score"] >= kind.least) if kind.least else spans


def with_spans(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a column, whose name is returned too, of the confirmed spans of every kind, by kind and start."""
    whole, spans, *names = fresh(docs.columns, "whole_", "spans_", *[f"{x}_{k.name}_" for k in KINDS for x in "ps"])
    df = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    for k, p in zip(KINDS, names[::2]):
        pieces = F.split(whole, k.pattern, -1)
        df = df.withColumn(p, F.when(F.contains(whole, F.lit(k.needs)), pieces) if k.needs else pieces)
    none = F.array().cast(SPAN)
    for i, (k, p, s) in enumerate(zip(KINDS, names[::2], names[1::2])):
        found = F.regexp_extract_all(whole, F.lit(k.pattern), F.lit(0))
        df = df.withColumn(s, F.when(F.size(p) > 1, _spans(i, k, F.col(whole), F.col(p), found)).otherwise(none))
    return df.withColumn(spans, F.concat(*names[1::2])).drop(whole, *names), spans


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the spans of each document as structs of kind, start, end (code points, exclusive) and score."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    df, spans = with_spans(only(docs, "doc_id", "text"))
    named = F.transform(spans, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    return df.select("doc_id", named.alias("spans"))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans become one, named by the first."""
    df, spans = with_spans(docs, text)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    whole = F.col(text)

    def step(state: Column, s: Column) -> Column:
        end, fresh = -s["back"], s["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], F.array(whole.substr(state["at"] + 1, s["start"] - state["at"]), F.element_at(names, s["kind"] + 1)))).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(end, state["at"]).alias("at"))

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    masked = F.aggregate(ordered, zero, step, lambda s: F.concat(F.array_join(s["out"], ""), whole.substr(s["at"] + 1, F.length(whole))))
    return df.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(whole)).drop(spans)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, spans = with_spans(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))

    def count(i: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == i)).cast("long")  # of one parameter: Spark would give a second the element's place

    counts = [count(i).alias(f"n_{k.name}") for i, k in enumerate(BASE)]
    return df.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col(spans)).alias("spans"), F.transform(spans, lambda s: s["score"]).alias("scores"))
