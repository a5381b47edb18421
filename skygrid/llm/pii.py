"""Personal data: patterns propose spans, checksums confirm, context scores.

Everything here is a native column expression. Positions come from splitting a
text by the very pattern that extracts its matches, so the lengths of gaps and
matches give offsets in code points.

The base kinds (email, ip, card, phone) are kept whenever their own check
passes. The further kinds need evidence: an iban its mod-97 checksum, a
national number in 3-2-4 digits or a local phone number a context word nearby;
they are kept from ``THRESHOLD`` on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, table

# Each pattern starts only where a match of its kind can start and never scans
# a run of its characters twice, so it is linear in the text.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?<!\.)(?!\.?[A-Za-z0-9-])"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+)-])(?<![0-9+)-]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"

KINDS = ("email", "ip", "card", "phone", "iban", "national", "localphone")
BASE = KINDS[:4]
THRESHOLD = 0.6
REACH = 40  # code points on either side in which context words count
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national": 0.3, "localphone": 0.3}
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(ip|host|server|address|adresse|servidor)\b",
    "card": r"(?i)\b(card|credit|visa|mastercard|tarjeta|carte|karte)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax|tel[eé]fono|t[eé]l[eé]phone|telefon)\b",
    "iban": r"(?i)\b(iban|account|bank|cuenta|compte|konto)\b",
    "national": r"(?i)\b(ssn|social security|tax id)\b",
    "localphone": r"(?i)\b(phone|tel|call|mobile|fax|tel[eé]fono|t[eé]l[eé]phone|telefon)\b",
}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        d = F.when((n - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return acc + d

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _mod97(s: Column) -> Column:
    plain = F.replace(s, F.lit(" "))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(acc, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _check(kind: str, s: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(s, r"\."), small)
    if kind == "card":
        return _luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    if kind == "iban":
        return (F.length(F.replace(s, F.lit(" "))) <= 34) & _mod97(s)
    return F.lit(True)


_SPAN = "array<struct<rank:int,kind:string,start:int,end:int,score:double>>"


def _spans(kind: str, pattern: str) -> Column:
    """Checked spans of one kind in column ``text``."""
    text = F.col("text")
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # (end of the last match, spans so far) along the zipped gaps and matches
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc, x):
        s = acc["at"] + x["gap"]
        e = s + F.length(x["hit"])
        one = F.array(F.struct(s.alias("start"), e.alias("end"), x["hit"].alias("text")))
        return F.struct(e.alias("at"), F.concat(acc["out"], one).alias("out"))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda x: x["hit"].isNotNull())
    placed = F.filter(F.aggregate(pairs, start, step, lambda a: a["out"]), lambda x: _check(kind, x["text"]))

    def scored(x):
        near = F.concat(
            F.substring(text, F.greatest(x["start"] + 1 - REACH, F.lit(1)), F.least(x["start"], F.lit(REACH))),
            F.lit(" "),
            F.substring(text, x["end"] + 1, F.lit(REACH)),
        )
        lift = F.when(near.rlike(CONTEXT[kind]), 0.4).otherwise(0.0)
        score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + lift)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score")
        )

    out = F.transform(placed, scored)
    if kind not in BASE:
        out = F.filter(out, lambda x: x["score"] >= THRESHOLD)
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "national": NATIONAL, "localphone": LOCAL_PHONE}


def with_spans(docs: DataFrame, column: str = "pii_spans") -> DataFrame:
    """``docs`` with an array of (rank, kind, start, end, score) structs, sorted
    by kind and start; offsets are code points, end exclusive.

    Null and empty texts have no spans; texts of any length are read whole, each
    pattern in time linear in them; spans of different kinds may overlap, and of
    equal starts the kinds come in their order; every input row gives one row,
    repeats and extra columns included; an empty table stays empty.
    """
    each = docs.withColumn(column, F.struct(*[_spans(k, p).alias(k) for k, p in PATTERNS.items()]))
    return each.withColumn(column, F.concat(*[F.col(column)[k] for k in KINDS]))


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every span replaced by ``[KIND]``;
    overlapping spans become one mark, that of the first. Rows without spans, null
    and empty texts keep their text; repeated rows and an empty table stay."""
    mark = free_name(docs, "pii")
    found = with_spans(docs, mark)
    text = F.col("text")
    ordered = F.array_sort(F.transform(F.col(mark), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc, s):
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    built = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return found.withColumn("text", F.when(F.size(F.col(mark)) > 0, built).otherwise(text)).drop(mark)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = with_spans(docs, "found")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return d.select("doc_id", *[count(k) for k in BASE], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))
