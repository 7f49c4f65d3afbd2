r"""Quality rules as a ledger of bits: rules are evaluated once, policies are masks over the stored bits.

ledger() reads each text once and keeps its measurements and one bit for each rule that it fails. A policy is a named,
versioned set of rules, so applying another version, or asking what each rule alone removes (ablation), is bit
arithmetic over the ledger, which is a hundredth of the texts. Only DataFrame functions are used, nothing is shuffled:
repeated windows of words are found inside a row, by sorting the windows' hashes with their places.

Words are `[^\x20\x09-\x0D]+`. Null and empty texts have no words and fail the rule on length; repeated rows are judged
each for itself; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """fails: a SQL condition over the measurements, the same in any engine; bits are given out by place in RULES."""

    name: str
    fails: str


RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 10 * n_words"),
    Rule("too_many_words", "n_words > 100000"),
)
BASE = ("too_few_words", "repeated_windows")
#: Versions of the policy; a document is kept if it fails none of the version's rules.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "duplicate_lines"),
    "v3": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words"),
}
CURRENT = "v3"


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << k for k, rule in enumerate(RULES) if rule.name in rules)


def measure(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and the measurements, and with carry all of docs as column row; every intermediate array is a column of
    its own, so that no lambda recomputes it."""
    extra = ["row"] * carry
    text = F.coalesce("text", F.lit(""))
    blanks, symbols = "\t\n\x0b\x0c\r", "#*$%&|<>"
    solid = F.translate("t", " " + blanks, "")
    rows = docs.select("doc_id", text.alias("t"), *[F.struct(*[docs[c] for c in docs.columns]).alias(r) for r in extra]).select(
        "doc_id", *extra,
        F.array_remove(F.split(F.translate("t", blanks, " " * len(blanks)), " "), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.translate(x, " " + blanks, "") != "").alias("lines"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", symbols, ""))).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "doc_id", *extra, "w", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("case when size(w) < 3 then cast(array() as array<bigint>) else slice(transform(w, (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))), 1, size(w) - 2) end").alias("grams"),
    ).drop("w")
    rows = rows.withColumn("repeats", F.size("grams") > F.size(F.array_distinct("grams")))
    rows = rows.withColumn("placed", F.expr("case when repeats then sort_array(transform(grams, (h, i) -> struct(h as h, i as p))) end"))
    rows = rows.withColumn("places", F.expr("case when repeats then sort_array(transform(filter(placed, (e, i) -> e.h <=> get(placed, i - 1).h or e.h <=> get(placed, i + 1).h), e -> e.p)) end"))
    covered = F.expr("case when repeats then aggregate(transform(places, (p, i) -> least(3, coalesce(get(places, i + 1) - p, 3))), 0, (a, x) -> a + x) else 0 end")
    return rows.select("doc_id", *extra, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "n_lines")


def ledger(docs: DataFrame, carry: bool = False) -> DataFrame:
    """measure() and failed, the bits of all rules that the document fails."""
    bits: Column = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, carry).withColumn("failed", bits)


def judge(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds base_failed and kept, the verdict of a version of the policy, to ledger entries."""
    failing = lambda rules: F.col("failed").bitwiseAND(F.lit(mask(rules)).cast("long")) != 0
    return entries.withColumn("base_failed", failing(BASE)).withColumn("kept", ~failing(BASE) & ~failing(POLICIES[version]))


def kept_rows(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of docs that a version of the policy keeps. The verdict passes through a generator, below which the
    optimiser moves no filter: moved further down it would be written out within the measurements' lambdas."""
    judged = judge(ledger(docs, carry=True), version)
    held = judged.select(F.explode_outer(F.expr("case when kept then array(row) end")).alias("row"))
    return held.where("row is not null").select("row.*")


def ablation(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a version: documents that fail it (n_failed) and that it alone removes (n_only). Entries are
    first counted by bit pattern, of which there are at most 2 to the number of rules."""
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(RULES) if r.name in POLICIES[version]])
    each = patterns.select("bits", "n", F.explode(names).alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))


def _sql() -> str:
    bits = " | ".join(f"case when {r.fails} then {1 << k} else 0 end" for k, r in enumerate(RULES))
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select rid, unnest(range(1, len(w) - 1)) as p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from w where len(w) > 2),
r as (select rid, p from g qualify count(*) over (partition by rid, g) > 1),
c as (select rid, count(distinct q) as n from (select rid, unnest([p, p + 1, p + 2]) as q from r) group by rid),
m as (select rid, doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
  cast(len(l) as bigint) as n_lines from w),
f as (select m.*, cast(coalesce(c.n, 0) as bigint) as n_repeat_words from m left join c using (rid)),
b as (select *, cast({bits} as bigint) as failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failed,
  failed & {mask(BASE)} <> 0 as base_failed, failed & {mask((*BASE, *POLICIES[CURRENT]))} = 0 as kept from b
"""


SQL = _sql()
