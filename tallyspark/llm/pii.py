"""Personal data: strong patterns, and candidates chosen by gradient-boosted trees; DataFrame functions only.

Generators with high recall propose spans that may overlap: numbers grouped like telephone numbers
without a plus, long digit runs, addresses with "at" and "dot" spelled out. Trees see the format of
a candidate and the words around it, but not the marks that make a strong pattern match: the plus
and country code of a telephone number and the @ and dots of an address are hidden, and spelled-out ones are read
as them. They learn from all candidates that a strong span of their kind confirms
and from those that a check refutes: by checksum, by a part over 255, by the number of digits, as a
calendar date, as four numbers between dots, or as a bare run of digits that no word before it speaks of. All others have no label:
they are what may be added. For each generator a threshold is calibrated on the labelled candidates
of the texts that were held out, a third of them. A chosen candidate is added unless it overlaps a span that is there
already. Texts are read once; no shuffle is needed for spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.boosted import calibrated, train
from tallyspark.llm.common import text_or_empty, written

#: Strong kinds, in their order. Possessive forms match what the plain ones do, without backtracking.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "phone_like": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){8,18}(?![0-9A-Za-z])",
    "card_like": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20.-]?[0-9]{2,6}){2,4}(?![0-9A-Za-z])",
    "email_like": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]{2,}+)++",
    "ip_like": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])",
}
#: What a text must contain for a pattern to match; cheap to look for.
HINTS = {"email": "@", "phone": r"\+[0-9]", "email_like": r"@|[(\[]at[)\]]"}
DIGIT = "[0-9]"
KINDS = [*BASE, *GENERATORS]
CONTEXT = {"phone": "phone|tel|call|mobile|fax|whatsapp", "card": "card|visa|credit|debit|amex|pay", "mail": "mail|contact|write|reach", "address": r"\bip\b|address|host|server|login"}
#: The words of context that count for a generator; others say more about the texts at hand than about the candidate.
OWN_WORDS = {"phone_like": "phone", "card_like": "card", "email_like": "mail", "ip_like": "address"}
PRECISION = 0.95
BLOCK = 64
#: Words and marks of an address as they are spelled out, and what they stand for.
SPELLED = ((r"\x20?[(\[]at[)\]]\x20?", "@"), (r"\x20?[(\[]dot[)\]]\x20?", "."))
#: The plus and country code of a telephone number, which numbers without a plus lack.
COUNTRY = r"^\+[0-9]{1,3}[\x20().-]+"
#: A calendar date, by year or by day first, as the start of a number.
DATE = r"^\(?(?:(?:19|20)[0-9]{2}([\x20.-]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([\x20.-])(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2})(?![0-9])"
FEATURES = ["digits", "letters", "groups", "longest", "distinct", "luhn", "parts", "alone", "same", *(f"near_{k}" for k in CONTEXT), *(f"by_{g}" for g in GENERATORS)]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns computed once per row: a generator keeps them from being copied into what uses them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def starts(gaps: Column, matches: Column) -> Column:
    """Where each match starts: the lengths of all gaps up to it and of all matches before it.

    Prefix sums by blocks, so that many matches in one text don't cost their square.
    """
    lengths = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK)), lambda b: F.slice(lengths, (b * BLOCK + 1).cast("int"), BLOCK))
    within = F.transform(blocks, lambda xs: F.struct(total(xs).alias("sum"), F.transform(xs, lambda x, i: total(F.slice(xs, 1, i))).alias("at")))
    return F.flatten(F.transform(F.transform(within, lambda w, i: F.struct(w["at"].alias("at"), i.alias("i"))), lambda w: F.transform(w["at"], lambda x: x + total(F.slice(F.transform(within, lambda v: v["sum"]), 1, w["i"])))))


def matched(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """A column for each kind: array of (start, end, value, before, after) of its matches, in code points."""
    hints = {h: f"_h_{i}" for i, h in enumerate(dict.fromkeys(HINTS.get(k, DIGIT) for k in patterns))}
    hinted = once(df, **{c: F.rlike(F.col(text), F.lit(h)) for h, c in hints.items()})
    needed = {k: F.col(hints[HINTS.get(k, DIGIT)]) for k in patterns}
    none = F.array().cast("array<string>")
    found = once(hinted, **{f"_m_{k}": F.when(needed[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    some = lambda k: F.size(f"_m_{k}") > 0
    gaps = once(found, **{f"_g_{k}": F.when(some(k), F.split(text, p, -1)) for k, p in patterns.items()})
    placed = once(gaps, **{f"_s_{k}": F.when(some(k), lengths_before(f"_g_{k}", f"_m_{k}")) for k in patterns})
    kind = "array<struct<start:int,end:int,value:string,before:string,after:string>>"

    def spans(k: str) -> Column:
        rows = F.arrays_zip(F.col(f"_s_{k}").alias("s"), F.col(f"_m_{k}").alias("m"), F.slice(f"_g_{k}", 1, F.size(f"_m_{k}")).alias("b"), F.slice(f"_g_{k}", 2, F.size(f"_m_{k}")).alias("a"))
        made = F.transform(rows, lambda r: F.struct(r["s"].cast("int").alias("start"), (r["s"] + F.length(r["m"])).cast("int").alias("end"), r["m"].alias("value"), F.lower(F.right(r["b"], F.lit(32))).alias("before"), F.left(r["a"], F.lit(1)).alias("after")))
        return F.when(some(k), made.cast(kind)).otherwise(F.array().cast(kind))

    out = once(placed, **{f"_{k}": spans(k) for k in patterns})
    return out.drop(*(f"_{x}_{k}" for k in patterns for x in "mgs"), *hints.values())


def lengths_before(gaps: str, matches: str) -> Column:
    """``starts`` less the matches themselves: sums up to the gap before each match."""
    ends = starts(F.col(gaps), F.col(matches))
    return F.zip_with(ends, F.slice(gaps, 1, F.size(matches)), lambda s, g: s + F.length(g))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def low_parts(value: Column) -> Column:
    """Whether all parts between dots are numbers up to 255."""
    return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))


def valid(kind: str, value: Column) -> Column:
    digits = digits_of(value)
    if kind == "ip":
        return low_parts(value)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def refuted(kind: str, value: Column, before: Column) -> Column:
    """Whether a check says that a candidate is not what its generator looks for."""
    digits = digits_of(value)
    n = F.length(digits)
    if kind == "email_like":
        return F.lit(False)
    if kind == "ip_like":
        return ~low_parts(value)
    if kind == "card_like":
        return ~F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    bare = ~F.rlike(value, F.lit(r"[0-9][^0-9]+[0-9]")) & ~F.rlike(before, F.lit(CONTEXT["phone"]))
    quad = F.rlike(value, F.lit(r"^[0-9]+(\.[0-9]+){3}$"))  # an address or a version
    return ~n.between(9, 15) | F.rlike(value, F.lit(DATE)) | quad | bare


def candidates(kind: str, base: Column) -> Column:
    """Candidates of one generator with features, label (1 confirmed, 0 refuted, else null), and whether a strong span overlaps them."""

    def features(c: Column) -> Column:
        value, before = c["value"], F.regexp_replace(c["before"], r"[+(]+$", "")
        for spelled, mark in SPELLED:
            value = F.regexp_replace(value, spelled, mark)
        value = F.regexp_replace(value, COUNTRY, "")
        digits = digits_of(value)
        groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
        made = {
            "digits": F.length(digits),
            "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
            "groups": F.size(groups),
            "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
            "distinct": F.size(F.array_distinct(F.split(digits, ""))),
            "luhn": F.when(F.length(digits) > 1, luhn(digits)).otherwise(False).cast("int"),
            "parts": F.when(F.size(groups) == 4, low_parts(F.concat_ws(".", groups))).otherwise(False).cast("int"),
            "alone": F.rlike(before, F.lit(r"[\s]$|^$")).cast("int"),
            "same": F.rlike(value, F.lit(r"([0-9])\1{5}")).cast("int"),
            **{f"near_{k}": F.rlike(before, F.lit(p)).cast("int") if k == OWN_WORDS[kind] else F.lit(0) for k, p in CONTEXT.items()},
            **{f"by_{g}": F.lit(int(g == kind)) for g in GENERATORS},
        }
        overlap = lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])
        confirms = lambda b: (b["kind"] == kind.removesuffix("_like")) & (b["start"] <= c["start"]) & (c["end"] <= b["end"])
        return F.struct(
            F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
            F.when(F.exists(base, confirms), 1).when(refuted(kind, c["value"], before), 0).alias("label"), F.exists(base, overlap).alias("taken"),
            F.struct(*(v.cast("double").alias(k) for k, v in made.items())).alias("f"),
        )

    return F.transform(F.col(f"_{kind}"), features)


def joined(spans: Column) -> Column:
    """kind:start:end of spans sorted by start, then kind."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def proposed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """doc_id, the strong spans and the candidates of each row."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    rows = matched(matched(source, "text", BASE), "text", GENERATORS)
    strong = lambda k: F.transform(F.filter(f"_{k}", lambda s: valid(k, s["value"])), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.concat(*map(strong, BASE))
    with_base = once(rows, base=base)
    return with_base.select("doc_id", "base", F.concat(*(candidates(k, F.col("base")) for k in GENERATORS)).alias("found"))


def scanned(docs: DataFrame, id_column: str = "doc_id", text: str = "text", *, precision: float = PRECISION) -> DataFrame:
    """Per row: doc_id, counts and digest of the strong spans, and all spans as kind:start:end in code points.

    Null texts are empty and have no spans. Every row is answered, equal ones alike; null ids stay
    null. Where labelled candidates are too few to train on, nothing is added to the strong spans;
    what a check refutes never is. Candidates of one kind don't overlap; those of two kinds may.
    """
    rows = written(proposed(docs, id_column, text), "candidates")
    each = rows.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.kind", "c.start", "c.end", "c.label", "c.f.*")
    labelled = each.where("label IS NOT NULL")
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    trees = train(labelled.where(~held_out), FEATURES)
    added = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    if trees:
        limits = calibrated(labelled.where(held_out), F.col("kind"), trees.probability(F.col), F.col("label"), precision)
        if limits:
            table = F.create_map(*(F.lit(x) for pair in sorted(limits.items()) for x in pair))
            chosen = F.filter("found", lambda c: ~c["taken"] & F.coalesce(c["label"] != 0, F.lit(True)) & (F.floor(trees.probability(lambda f: c["f"][f]) * 100) / 100 >= table[c["kind"]]))
            slim = F.array_sort(F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
            added = F.transform(slim, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.concat(F.col("base"), added)
    return rows.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))
