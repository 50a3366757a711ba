"""Quality rules as a bitmask ledger, in native DataFrame expressions only.

`measure` computes every measurement of a text once; `ledger` turns them into one bit per failed rule. A policy is a
version with the mask of the rules that it enforces, so applying, comparing or ablating policies needs no text: it is a
bitwise AND on the ledger. `ablation` counts for each policy and rule the documents that this rule alone rejects.

Repeated five-word windows are looked for in two steps inside the row: an array of 64-bit window hashes is sorted and
neighbours compared (equal windows have equal hashes, so none is missed), and only rows with equal hashes sort the
windows themselves, so the counts are exact.

Nulls: a null text counts as an empty one, which fails too_few_words; other columns aren't read. Repeated rows are
judged each for itself. Long texts are measured whole, in arrays of their words; a text's arrays must fit in a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm import common

SPACE = " \\t\\n\\u000B\\f\\r"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measurements; true means that the text breaks the rule."""

    name: str
    fails: str


#: The position of a rule is its bit; append only. The first two are the base that every policy enforces.
RULES = (
    Rule("too_few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("too_many_words", "n_words > 100000"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("symbols", "n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
)
BASE = 0b11


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int


#: v2 rejects no text for its length alone; too_many_words stays in the ledger as a measurement.
POLICIES = (Policy("base", BASE), Policy("v1", 0b1111111), Policy("v1-lenient", 0b0011111), Policy("v2", 0b1111011))
CURRENT = POLICIES[3]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long); columns of these names are replaced, all others (or those in `keep`) stay, whatever their names."""
    others = [c for c in (docs.columns if keep is None else keep) if c not in MEASURES]
    row = F.struct(*(F.col(f"`{c}`") for c in others), F.lit(True).alias("__row")).alias("row")
    df = docs.select(row, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    words = F.array_remove(F.split("t", f"[{SPACE}]+"), "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    symbols = F.size(F.regexp_extract_all("t", F.lit("[#*$%&|<>]"), F.lit(0)))
    df = df.select("row", words.alias("words"), lines.alias("lines"), symbols.cast("long").alias("n_symbols"))
    window = lambda f, before="": f"{f}({before}{', '.join(f'get(words, i + {k})' for k in range(WINDOW))})"
    hashes = F.expr(f"if(size(words) > {WINDOW}, sort_array(transform(sequence(0, size(words) - {WINDOW}), i -> {window('xxhash64')})), array())")
    df = df.select("row", "words", "n_symbols", F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), hashes.alias("hashes"))
    suspect = "size(hashes) > size(array_distinct(hashes))"
    df = df.withColumn("suspect", F.expr(suspect)).drop("hashes")
    # (window, start) in order; a start counts if a neighbour has the same window
    joined = window("concat_ws", "' ', ")
    windows = f"if(suspect, sort_array(transform(sequence(0, size(words) - {WINDOW}), i -> struct({joined} as w, i as i))), array())"
    df = df.withColumn("windows", F.expr(windows))
    twice = "sort_array(transform(filter(windows, (x, j) -> (j > 0 and get(windows, j - 1).w = x.w) or (j < size(windows) - 1 and get(windows, j + 1).w = x.w)), x -> x.i))"
    df = df.withColumn("starts", F.expr(twice)).drop("windows")
    covered = f"aggregate(starts, named_struct('n', 0L, 'end', 0), (s, i) -> named_struct('n', s.n + (i + {WINDOW} - greatest(i, s.end)), 'end', i + {WINDOW}), s -> s.n)"
    # the generator keeps later filters from being pushed below with copies of these expressions
    measured = df.withColumn("n_repeat_words", F.expr(covered)).select("row", F.inline(F.array(F.struct(*MEASURES))))
    return measured.select(*(F.col(f"row.`{c}`").alias(c) for c in others), *MEASURES)


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measured with failed (long): bit i is set if rules[i] fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def apply_policy(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """rows of a ledger with base_failed and kept under the policy."""
    broken = lambda mask: F.col("failed").bitwiseAND(F.lit(mask).cast("long")) != 0
    return rows.withColumns({"base_failed": broken(BASE), "kept": ~broken(BASE | policy.mask)})


def ablation(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each policy and rule it enforces: documents that break the rule, and those that only this rule rejects. One pass over the distinct masks."""
    masks = rows.groupBy("failed").count()
    cases = [(p.version, p.mask, r.name, 1 << i) for p in policies for i, r in enumerate(rules) if p.mask >> i & 1]
    per = F.explode(F.array([F.struct(*[F.lit(x).alias(n) for n, x in zip(("policy", "mask", "rule", "bit"), c)]) for c in cases]))
    hit = F.col("c.bit").bitwiseAND(F.col("failed")) != 0
    alone = F.col("c.mask").bitwiseAND(F.col("failed")) == F.col("c.bit")
    found = masks.select("failed", "count", per.alias("c"))
    return found.groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule")).agg(F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("n_failed"), F.sum(F.when(alone, F.col("count")).otherwise(0)).alias("n_only"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(ledger(measure(common.table(spark, sf_dir, "documents"), keep=["doc_id"])))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 4, 0))) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 5], ' ') AS k FROM p),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM r),
s AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(s.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN s ON s.doc_id = w.doc_id),
f AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (n_words > 100000)::BIGINT
      + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 20 * n_words)::BIGINT + 32 * (n_symbols > n_words)::BIGINT
      + 64 * (2 * n_dup_lines > n_lines)::BIGINT)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 123) = 0 AS kept, failed FROM f
"""


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the current policy keeps, with their own columns, whatever their names."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    judged = apply_policy(ledger(measure(docs.select(row, F.col("text").alias("text")))))
    return judged.where("kept").select("row.*")
