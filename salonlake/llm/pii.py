"""Personal data: regular expressions propose, checksums confirm, context scores.

Native DataFrame expressions only. ``regexp_extract_all`` gives the matches of a
kind and ``split`` the gaps between them with the same pattern, so running sums
of their lengths give every match's place in code points. Only documents that
hold a character a kind needs ('@', a digit) meet that kind's pattern, and only
match lengths and the short matched strings leave the scan; the running sums
are window sums inside one document.

Where an account number ends, no pattern can tell: capitalised words and numbers
may follow it. Its pattern takes only the four characters it starts with and
looks ahead at the words that may belong to it; of these as many are taken as the
country's length says, else as many as pass the checksum. Numbers that start
inside another are found as well, so spans of this kind may overlap.

The patterns are possessive where the next character decides, which keeps the
leftmost, longest matches of the plain forms and makes them linear on long runs.

Defined results: a null text is an empty text; null ids and repeated rows are
documents of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a text without a match of this cheap pattern has none of the kind
    score: float  # of a confirmed match, before its context is seen
    context: str  # words within CONTEXT characters that raise the score
    base: bool = True
    group: int = 0  # of the pattern: the match's value, with what follows it
    size: int | None = None  # characters that a match takes, if not its value's


#: Characters looked at on either side, what a context word adds, least score.
CONTEXT, BOOST, LEAST = 40, 0.35, 0.5

#: Shortest and longest account number, and the lengths that countries have set.
#: Numbers of other countries (or of other lengths) are confirmed by checksum alone.
IBAN_LEAST, IBAN_MOST = 15, 34
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU"}
#: All words that may belong to an account number, the last one whole.
_ACCOUNT = (r"[A-Z]{2}[0-9]{2}[A-Z0-9]{0,30}+(?![A-Za-z0-9])"
            r"(?:\x20[A-Z0-9]{1,30}+(?![A-Za-z0-9])){0,30}+")

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "@", 0.9, r"(?i)\b(?:e-?mail|contact|write to)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         r"[0-9]\.[0-9]", 0.6, r"(?i)\b(?:ip|host|server|address)\b"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++",
         "[0-9]", 0.7, r"(?i)\b(?:card|visa|credit|payment)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         r"\+[0-9]", 0.7, r"(?i)\b(?:phone|tel|call|mobile|fax)\b"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=({_ACCOUNT}(?s:.{{0,{CONTEXT}}})))[A-Z]{{2}}[0-9]{{2}}",
         "[A-Z]{2}[0-9]{2}", 0.8, r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b", base=False, group=1, size=4),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         "[0-9]{3}-[0-9]{2}-", 0.3, r"(?i)\b(?:ssn|social security|national id|tax id)\b", base=False),
)
BASE = sum(k.base for k in KINDS)


def _order(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k.name, i)))[kind]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn sum of up to 19 digits is a multiple of ten."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for i in range(19):  # from the right: positions 18, 17, ...
        d = F.ascii(F.substring(padded, 19 - i, 1)) - 48
        total = total + (d if i % 2 == 0 else F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """The rearranged account number, letters as 10..35, leaves 1 modulo 97."""
    flat = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(flat, 5, 34), F.substring(flat, 1, 4))
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).when(
        F.ascii(c) > 64, (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.ascii(c) - 48) % 97))
    return rest == 1


def account(value: Column) -> Column:
    """The account number that ``value`` begins with, null if there is none:
    whole words that pass the checksum and have the country's length, or else
    as many as pass it."""
    words = F.split(F.regexp_extract(value, "^" + _ACCOUNT, 0), " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    size = F.create_map(*(F.lit(x) for n, names in IBAN_SIZES.items() for c in names.split() for x in (c, n)))

    def flat(head: Column) -> Column:
        return F.length(F.regexp_replace(head, " ", ""))

    sure = F.filter(heads, lambda h: flat(h).between(IBAN_LEAST, IBAN_MOST) & mod97(h))
    own = F.filter(sure, lambda h: F.coalesce(flat(h) == F.try_element_at(size, F.substring(value, 1, 2)), F.lit(False)))
    return F.coalesce(F.get(own, F.lit(0)), F.get(sure, F.size(sure) - 1))


def _confirmed(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    octet = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})?"
    return (F.when(kind == "ip", value.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
            .when(kind == "card", F.length(digits).between(12, 19) & luhn(digits))
            .when(kind == "phone", F.length(digits).between(9, 15))
            .when(kind == "iban", value.isNotNull())
            .otherwise(True))


def proposals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(_k, kind, i, value, gap, size, tail, head) of every proposed match of
    ``docs`` (unique key ``_k``): its text, the code points between the match
    before it and itself, those it takes, and the text on either side."""
    text, parts = F.col(text_col), []
    for k in KINDS:
        hit = text.contains(k.needs) if k.needs == "@" else text.rlike(k.needs)
        gaps = F.transform(F.split(text, k.pattern, -1), lambda g: F.struct(
            F.length(g).cast("long").alias("n"), F.substring(g, 1, CONTEXT).alias("head"),
            F.substring(g, -CONTEXT, CONTEXT).alias("tail")))
        parts.append(F.when(hit, F.struct(F.lit(k.name).alias("kind"), gaps.alias("gaps"), F.regexp_extract_all(
            text, F.lit(k.pattern), F.lit(k.group)).alias("values"))))
    each = docs.select("_k", F.explode(F.array(*parts)).alias("m")).filter("size(m.values) > 0")
    each = each.select("_k", "m.kind", F.posexplode(F.arrays_zip(
        F.col("m.values").alias("value"), F.col("m.gaps").alias("before"),
        F.slice("m.gaps", 2, F.size("m.gaps")).alias("after"))).alias("i", "x")).filter("x.value is not null")
    size = F.length("x.value")
    for k in KINDS:
        size = size if k.size is None else F.when(F.col("kind") == k.name, k.size).otherwise(size)
    return each.select("_k", "kind", "i", "x.value", F.col("x.before.n").alias("gap"), size.cast("long").alias("size"),
                       F.col("x.before.tail").alias("tail"), F.col("x.after.head").alias("head"))


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(_k, kind, start, end, value, score) of every confirmed match, in code
    points, end exclusive. Kinds beside the base ones need a score of LEAST."""
    w = Window.partitionBy("_k", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(w)
    placed = proposals(docs, text_col).withColumn("start", end - F.col("size"))
    # What follows an account number stands behind it in its value.
    iban, found = F.col("kind") == "iban", F.col("value")
    placed = placed.withColumn("found", found).withColumn("value", F.when(iban, account(found)).otherwise(found))
    after = F.when(iban, F.substring("found", F.length("value") + 1, F.lit(CONTEXT))).otherwise(F.col("head"))
    placed = placed.withColumn("end", F.col("start") + F.length("value"))
    sure = placed.filter(_confirmed(F.col("kind"), F.col("value"))).withColumn(
        "score", _score(F.col("kind"), F.concat_ws(" ", "tail", after)))
    base = F.col("kind").isin([k.name for k in KINDS if k.base])
    return sure.filter(base | (F.col("score") >= LEAST)).select("_k", "kind", "start", "end", "value", "score")


def _score(kind: Column, around: Column) -> Column:
    out = F.lit(0.0)
    for k in KINDS:
        boost = F.when(around.rlike(k.context), BOOST).otherwise(0.0)
        out = F.when(kind == k.name, F.least(F.lit(1.0), k.score + boost)).otherwise(out)
    return out


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (unique key ``_k``) with ``spans``: array of (start, order,
    end, kind, score) sorted by start, then kind as listed; empty if none."""
    found = spans(docs, text_col).groupBy("_k").agg(F.sort_array(F.collect_list(F.struct(
        "start", _order(F.col("kind")).alias("order"), "end", "kind", "score"))).alias("spans"))
    none = F.array().cast(found.schema["spans"].dataType)
    rest = [F.col(f"d.{c}") for c in docs.columns]
    return docs.alias("d").join(found.alias("f"), F.col("d._k") == F.col("f._k"), "left").select(
        *rest, F.coalesce("f.spans", none).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (with key ``_k``) where every found span is replaced by its kind
    in brackets; of overlapping spans the first, then longest, names the place
    and the union is replaced."""
    found = detect(docs, text_col)
    text = F.col(text_col)
    # One pass over the sorted spans: cut what lies between them, join at last.
    done = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("parts")),
        lambda a, s: F.when(s["start"] < a["end"], F.struct(
            F.greatest(a["end"], s["end"]).alias("end"), a["parts"].alias("parts"))).otherwise(F.struct(
                s["end"].alias("end"), F.concat(a["parts"], F.array(
                    text.substr((a["end"] + 1).cast("int"), (s["start"] - a["end"]).cast("int")),
                    F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("parts"))),
        lambda a: F.concat(F.array_join(a["parts"], ""), text.substr((a["end"] + 1).cast("int"), F.length(text))))
    return found.withColumn(text_col, F.when(F.size("spans") > 0, done).otherwise(text)).drop("spans")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its personal data replaced, whatever its columns' names."""
    own = f"_doc_{id_col}"
    rows = common.wrapped(docs)
    rows = common.keyed(rows, own, *(c for c in rows.columns if c != own))
    return common.unwrapped(redact(rows, f"_doc_{text_col}"), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.keyed(common.documents(spark, sf_dir), "doc_id", "text")
    found = detect(docs)
    base = F.filter("spans", lambda s: s["order"] < BASE)

    def shown(xs: Column) -> Column:
        return F.array_join(F.transform(xs, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    return found.select("doc_id", *(count(k.name) for k in KINDS if k.base),
                        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
