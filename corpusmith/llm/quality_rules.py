"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document and the ledger is stored: the
measurements and one bit a failed rule. A policy is a mask, a new policy is another
mask over the stored ledger, and an ablation is a sum over (fail_bits & mask).
``stored_rows`` stores each document's row beside its ledger, so that a policy
filters rows without a join.

Terms of abuse come from two places: a fixed general list, and a list learned
from labelled documents (``toxic_terms``), since no list covers every language.

Defined results: a null or empty text fails ``empty`` and measures 0 everywhere
(no other rule looks at it); repeated rows get a ledger row each; a null doc_id
stays null; other columns are not read, so their names cannot clash; an empty
table gives an empty ledger; very long texts are measured whole, and no rule asks
for a length. Without labels only the fixed list counts; of several labels of one
doc_id the greatest counts, a label with a null doc_id or toxic doesn't; the bound
takes the least md5(doc_id), which no two doc_ids share.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.shared import written

#: General English terms of abuse; a parameter of ledger().
INSULTS = ("arsehole", "asshole", "bastard", "bitch", "bullshit", "cretin", "cunt", "dickhead", "disgusting", "dumbass", "fucking", "idiot", "idiotic", "imbecile", "jackass", "loser", "lowlife", "moron", "moronic", "pathetic", "prick", "retard", "scum", "scumbag", "slut", "stupid", "subhuman", "trash", "twat", "vermin", "wanker", "whore", "worthless")
#: Labelled documents that toxic_terms reads at most, those whose md5(doc_id) is least.
LABELLED_BOUND = 20_000
#: A learned term is in so many toxic documents at least, and so many times as usual there as in others.
MIN_TOXIC_DOCS, MIN_RATIO = 5, 20


class Rule(NamedTuple):
    """fails: SQL over the measurements, in words that Spark and DuckDB both read."""

    name: str
    fails: str


RULES = (
    Rule("empty", "n_words = 0"),
    Rule("short", "n_words > 0 and n_words < 50"),
    Rule("word_length", "n_words > 0 and (n_solid < 2 * n_words or n_solid > 12 * n_words)"),
    Rule("symbols", "n_symbols * 2 > n_words and n_words > 0"),
    Rule("bars", "n_bars * 5 > n_words"),
    Rule("shouting", "n_upper * 2 > n_letters"),
    Rule("no_letters", "n_words >= 10 and n_letters * 2 < n_solid"),
    Rule("repeated_lines", "n_lines >= 4 and n_distinct_lines * 2 < n_lines"),
    # Distinct words grow with the root of a text's length: the second bound goes on from where the first ends, at 1,200 words.
    Rule("repeated_words", "n_words >= 20 and n_distinct_words * 5 < n_words and n_distinct_words * n_distinct_words < 48 * n_words"),
    Rule("placeholder", "n_placeholder > 0"),
    # Rates: one term in 60 words, or two and more at one in 500.
    Rule("abuse", "n_abuse * 60 > n_words or n_abuse >= 2 and n_abuse * 500 > n_words"),
)
BIT = {r.name: 1 << k for k, r in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Versioned policies. v1 also drops short texts, as rules for web pages do, and those of very short or long words, which drops
#: languages written without spaces; v2, the one in use, keeps both.
POLICIES = {
    "v1": mask(*BIT),
    "v2": mask("empty", "symbols", "bars", "shouting", "no_letters", "repeated_lines", "repeated_words", "placeholder", "abuse"),
}
PRODUCTION = "v2"
PLACEHOLDERS = ("lorem ipsum", "Lorem ipsum", "Lorem Ipsum", "LOREM IPSUM", "enable javascript", "enable JavaScript", "enable Javascript")
SYMBOLS = r"[#$%&*@^~<>{}\[\]\\=_]+"
_BITS = " + ".join(f"case when {r.fails} then {BIT[r.name]} else 0 end" for r in RULES)


def toxic_terms(docs: DataFrame, labels: DataFrame, bound: int = LABELLED_BOUND) -> list[str]:
    """Words that mark documents labelled toxic: in MIN_TOXIC_DOCS of them, and MIN_RATIO times as often as in others.

    Reads at most ``bound`` labelled documents. What comes to the driver is the list itself.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(bound)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = rows.select("doc_id", "toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where("word <> ''")
    per_word = found.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).where(F.col("bad") >= MIN_TOXIC_DOCS)
    n_bad, n_good = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    kept = per_word.where(F.col("bad") * (n_good + 1) >= MIN_RATIO * (F.col("good") + 1) * n_bad)
    return sorted(r.word for r in kept.select("word").collect())


def cases(term: str) -> set[str]:
    """The term in lower case, with a capital, and in capitals; comparing with these is cheaper than to lower every word."""
    up = "".join(c.upper() if len(c.upper()) == 1 else c for c in term)
    return {term, up[:1] + term[1:], up}


def _measured(held: DataFrame, terms: Iterable[str]) -> DataFrame:
    """The measurements of column t beside the column row. Two steps, so that each text is split once for all of them."""
    split = held.select(
        "row",
        "t",
        F.array_remove(F.split("t", r"[\t\n\f\r ]+"), "").alias("solid"),
        F.array_remove(F.split("t", r"[^\p{L}]+"), "").alias("plain"),
        F.array_remove(F.split("t", r" *\n[\n ]*"), "").alias("lines"),
    )
    n = lambda c: c.cast("long")
    gone = lambda pattern: n(F.length("t") - F.length(F.regexp_replace("t", pattern, "")))
    abusive = sorted({v for x in terms for v in cases(x)})
    said = F.lit(False)
    for x in PLACEHOLDERS:
        said = said | F.contains("t", F.lit(x))
    return split.select(
        "row",
        n(F.length("t")).alias("n_chars"),
        n(F.size("solid")).alias("n_words"),
        n(F.size(F.array_distinct("solid"))).alias("n_distinct_words"),
        n(F.length(F.array_join("solid", ""))).alias("n_solid"),
        n(F.length(F.array_join("plain", ""))).alias("n_letters"),
        gone(r"\p{Lu}+").alias("n_upper"),
        gone(SYMBOLS).alias("n_symbols"),
        n(F.length("t") - F.length(F.replace("t", F.lit("|"), F.lit("")))).alias("n_bars"),
        n(F.size("lines")).alias("n_lines"),
        n(F.size(F.array_distinct("lines"))).alias("n_distinct_lines"),
        n(said).alias("n_placeholder"),
        (n(F.size(F.filter("plain", lambda w: w.isin(*abusive)))) if abusive else F.lit(0).cast("long")).alias("n_abuse"),
    )


def ledger(docs: DataFrame, terms: Iterable[str] = INSULTS) -> DataFrame:
    """doc_id, the measurements and fail_bits of each row of docs: one narrow pass, no shuffle."""
    held = docs.select(docs["doc_id"].alias("row"), F.coalesce(docs["text"], F.lit("")).alias("t"))
    return _measured(held, terms).withColumnRenamed("row", "doc_id").withColumn("fail_bits", F.expr(_BITS).cast("long"))


def apply_policies(table: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """keep_<version> for each policy, from the ledger alone."""
    return table.withColumns({f"keep_{v}": F.col("fail_bits").bitwiseAND(F.lit(m)) == 0 for v, m in (policies or POLICIES).items()})


def ablation(table: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """For each policy and rule of it: documents that fail the rule, fail it alone, are kept, and would be kept without it.

    The ledger is reduced to counts by fail_bits first (at most 2^rules rows), so the rest does not depend on the corpus's size.
    """
    counts = table.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rows = [(v, r.name, BIT[r.name], m) for v, m in (policies or POLICIES).items() for r in RULES if m & BIT[r.name]]
    grid = table.sparkSession.createDataFrame(rows, "policy string, rule string, bit long, mask long")
    every = F.array(*(F.struct(F.lit(v).alias("policy"), F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit"), F.lit(m).cast("long").alias("mask")) for v, name, bit, m in rows))
    active = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    sums = (
        counts.select("fail_bits", "n", F.explode(every).alias("g"))
        .select("fail_bits", "n", "g.*")
        .groupBy("policy", "rule")
        .agg(
            total(active.bitwiseAND(F.col("bit")) != 0).alias("n_fail"),
            total(active == F.col("bit")).alias("n_only"),
            total(active == 0).alias("n_kept"),
            total(active.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
        )
    )
    # A row for each rule of an empty ledger too.
    names = ("n_fail", "n_only", "n_kept", "n_kept_without")
    return grid.select("policy", "rule").join(sums, ["policy", "rule"], "left").select("policy", "rule", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names))


def stored_rows(docs: DataFrame, terms: Iterable[str] = INSULTS) -> DataFrame:
    """The ledger with each row of docs beside it, in the struct row, so that none of its names can clash. Written."""
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("t"))
    return written(_measured(held, terms).withColumn("fail_bits", F.expr(_BITS).cast("long")), "ledger")


def kept_rows(stored: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The rows, with all their columns, that the policy keeps, by the stored bits; drop_written of it drops what is stored."""
    out = stored.where(F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0).select("row.*")
    out.shared_path = stored.shared_path
    return out


def keep(docs: DataFrame, terms: Iterable[str] = INSULTS, policy: str = PRODUCTION) -> DataFrame:
    """As kept_rows, of a ledger made now."""
    return kept_rows(stored_rows(docs, terms), policy)


def terms_sql(docs: str = "documents", labels: str = "labels", bound: int = LABELLED_BOUND) -> str:
    """The learned and the fixed terms as DuckDB SQL, one column w."""
    fixed = ", ".join(f"('{w}')" for w in INSULTS)
    return rf"""
select w from (values {fixed}) f(w) union
select w from (
  select w, sum(toxic) as bad, sum(1 - toxic) as good, any_value(n_bad) as n_bad, any_value(n_good) as n_good from (
    select doc_id, toxic, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\p{{L}}]+'))) as w, n_bad, n_good from (
      select *, sum(toxic) over () as n_bad, sum(1 - toxic) over () as n_good from {docs} join (
        select doc_id, max(toxic) as toxic from {labels} where doc_id is not null and toxic is not null group by doc_id
        order by md5(doc_id::varchar) limit {bound}) using (doc_id) where text is not null))
  where w <> '' group by w) where bad >= {MIN_TOXIC_DOCS} and bad * (n_good + 1) >= {MIN_RATIO} * (good + 1) * n_bad"""


def ledger_sql(docs: str = "documents", labels: str = "labels") -> str:
    """The ledger as DuckDB SQL."""
    gone = {"n_upper": r"\p{Lu}+", "n_symbols": SYMBOLS, "n_bars": r"\|+"}
    lost = ", ".join(f"length(t) - length(regexp_replace(t, '{k}', '', 'g')) as {n}" for n, k in gone.items())
    full = lambda pattern: f"list_filter(regexp_split_to_array(t, '{pattern}'), lambda w: w <> '')"
    return rf"""
with terms as materialized (select list(v) as ws from (select distinct unnest([w, upper(w[1]) || w[2:], upper(w)]) as v from ({terms_sql(docs, labels)}))),
a as (select doc_id, coalesce(text, '') as t from {docs}),
b as (select doc_id, t, {full('[\\t\\n\\f\\r ]+')} as solid, {full('[^\\p{L}]+')} as plain, {full(' *\\n[\\n ]*')} as lines from a),
c as (select doc_id, length(t) as n_chars, len(solid) as n_words, len(list_distinct(solid)) as n_distinct_words,
  coalesce(length(array_to_string(solid, '')), 0) as n_solid, coalesce(length(array_to_string(plain, '')), 0) as n_letters, {lost},
  len(lines) as n_lines, len(list_distinct(lines)) as n_distinct_lines,
  ({' or '.join(f"contains(t, '{x}')" for x in PLACEHOLDERS)})::bigint as n_placeholder,
  len(list_filter(plain, lambda w: list_contains(ws, w))) as n_abuse from b, terms)
select *, ({_BITS})::bigint as fail_bits from c"""


def policies_sql(docs: str = "documents", labels: str = "labels", policies: dict[str, int] | None = None) -> str:
    """The ledger with the policies' decisions as DuckDB SQL."""
    flags = ", ".join(f"(fail_bits & {m}) = 0 as keep_{v}" for v, m in (policies or POLICIES).items())
    return f"select *, {flags} from ({ledger_sql(docs, labels)})"


def ablation_sql(docs: str = "documents", labels: str = "labels", policies: dict[str, int] | None = None) -> str:
    rows = ", ".join(f"('{v}', '{r.name}', {BIT[r.name]}, {m})" for v, m in (policies or POLICIES).items() for r in RULES if m & BIT[r.name])
    return f"""select policy, rule, count(*) filter ((fail_bits & mask & bit) <> 0) as n_fail, count(*) filter ((fail_bits & mask) = bit) as n_only,
count(*) filter ((fail_bits & mask) = 0) as n_kept, count(*) filter ((fail_bits & mask & ~bit) = 0) as n_kept_without
from (values {rows}) g(policy, rule, bit, mask) left join ({ledger_sql(docs, labels)}) on true group by policy, rule"""
