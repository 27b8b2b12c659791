"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps its measurements
and one bit per failed rule.  Policies are versioned masks over those bits, so
a policy change or an ablation never reads the texts again.

Defined results: a null or blank text has no words, measures 0 everywhere and
fails ``few_words``.  Repeated doc_ids are judged row by row.  Very long texts
cost O(n log n) in their words.  Windows are compared by a 64-bit hash within
one document.  Extra columns are carried by ``ledger`` if named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import word_array

SYMBOLS = r"[#*$%&|<>]"
#: (name, SQL condition for failure over the measurements); the position is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("shouting", "n_upper > 50 and 100 * n_upper > 60 * word_chars"),
    ("exclaiming", "n_exclaim > n_words"),
)
BASE_RULES = ("few_words", "repeated_windows")
#: Versioned policies: the rules each one enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE_RULES,
    "v1": (*BASE_RULES, "symbol_heavy", "duplicate_lines", "shouting"),
    "v2": tuple(name for name, _ in RULES),
}


def mask(names: tuple[str, ...], rules=RULES) -> int:
    known = [name for name, _ in rules]
    return sum(1 << known.index(name) for name in names)


def measured(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the measurements and the columns in keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = [c for c in keep if c not in ("doc_id",)]
    base = docs.select("doc_id", *carried, text.alias("_t"))
    base = base.select(
        "doc_id", *carried,
        word_array(F.col("_t")).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.length("_t") - F.length(F.replace(F.col("_t"), F.lit("!"), F.lit("")))).cast("long").alias("n_exclaim"),
    )
    n = F.size("_w")
    windows = F.slice(F.arrays_zip("_w", F.slice("_w", F.lit(2), F.greatest(n, F.lit(1))).alias("_b"), F.slice("_w", F.lit(3), F.greatest(n, F.lit(1))).alias("_c")), F.lit(1), F.greatest(n - 2, F.lit(0)))
    base = base.select(
        "doc_id", *carried, "n_symbols", "n_upper", "n_exclaim",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(windows, lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("p")))).alias("_s"),
    )
    found = F.filter("_s", lambda x, i: (F.get("_s", i - 1).getField("h") == x.getField("h")) | (F.coalesce(F.get("_s", i + 1).getField("h") == x.getField("h"), F.lit(False))))
    places = F.sort_array(F.transform(found, lambda x: x.getField("p")))
    base = base.withColumn("_p", places).drop("_s")
    covered = F.aggregate(
        F.zip_with("_p", F.slice("_p", F.lit(2), F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
        F.lit(0), lambda total, step: total + step,
    )
    # a step that filters can't be pushed through: the optimizer would evaluate all of the above again for each of them
    stay = F.spark_partition_id() * F.lit(0)
    return base.withColumn("n_repeat_words", (covered + stay).cast("long")).drop("_p")


def ledger(docs: DataFrame, rules=RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Measurements and ``failed``, the bitmask of failed rules."""
    bits: Column = F.lit(0).cast("long")
    for bit, (_, failed) in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, keep).withColumn("failed", bits)


def with_policy(rows: DataFrame, policy: str, policies=POLICIES, rules=RULES) -> DataFrame:
    """Adds kept: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policies[policy], rules))) == 0)


def ablation(rows: DataFrame, policies=POLICIES, rules=RULES) -> DataFrame:
    """By policy and rule: documents that fail the rule, that fail no other rule of the policy, and
    that would be kept without it.  One aggregation over the ledger, no text is read."""
    cells = []
    for version, names in policies.items():
        whole = mask(names, rules)
        for name in names:
            own = mask((name,), rules)
            hit = F.col("failed").bitwiseAND(F.lit(whole))
            cells.append((version, name, F.count_if(hit.bitwiseAND(F.lit(own)) != 0), F.count_if(hit == own), F.count_if(hit.bitwiseAND(F.lit(whole & ~own)) == 0)))
    row = rows.agg(*[c.alias(f"_{i}_{j}") for i, cell in enumerate(cells) for j, c in enumerate(cell[2:])])
    table = F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.col(f"_{i}_0").alias("n_failed"), F.col(f"_{i}_1").alias("n_failed_alone"), F.col(f"_{i}_2").alias("n_kept_without")) for i, (v, r, *_) in enumerate(cells)])
    return row.select(F.inline(table))
