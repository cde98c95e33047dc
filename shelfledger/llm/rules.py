r"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Text statistics give each document a few junk ratios.  On all labelled texts, the cutoff of
every (stratum, rule) is the strictest one whose false rejection rate is proven small: the exact
binomial test of "more than ``risk`` of good documents are rejected" must be
refused.  Cutoffs of a rule are nested, so they are tested in a fixed sequence from lenient to
strict at no further cost; strata and rules share the error probability by Bonferroni.
The risk is divided by the number of rules, so that all rules together reject
at most ``risk`` of the good documents of a stratum, with probability 1 - ``error``.

A trial is a distinct text of a stratum: copies are no independent draws, so however many labelled documents hold
a text, it counts once, and not at all if their labels disagree.  A (stratum, rule) without proof rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.common import columns, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Cutoffs in parts per thousand, strict to lenient; a document above the cutoff is rejected.
CUTOFFS = (0, 5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 700)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stutters", "n_repeat_words")
RULES = ("symbol_share", "dup_line_share", "repeat_share", "stutter_share")
RISK = 0.05
ERROR = 0.05


@dataclass(frozen=True)
class Control:
    """Parameters of the proof."""

    risk: float = RISK
    error: float = ERROR
    cutoffs: tuple[int, ...] = CUTOFFS


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _repeated(starts: Column) -> Column:
    """Number of words covered by the windows that begin at ``starts`` (ascending)."""
    step = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("free")),
        lambda acc, at: F.struct(
            (acc["n"] + at + WINDOW - F.greatest(at, acc["free"])).alias("n"),
            (at + WINDOW).alias("free"),
        ),
    )
    return step["n"]


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each whole text; null counts as empty.

    Two 8-word windows are the same if their 64-bit hashes are.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = columns(docs, doc_id, text).select(
        F.col(doc_id).alias("doc_id"),
        words(body).alias("w"),
        F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("l"),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    last = F.size("w") - (WINDOW - 1)
    hashes = F.transform(F.sequence(F.lit(1), last), lambda k: F.xxhash64(F.slice("w", k, WINDOW)))
    stutter = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: a == b)
    found = found.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(stutter, lambda x: x)).cast("long").alias("n_stutters"),
        F.when(last > 0, hashes).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    ranked = F.array_sort(
        F.transform("h", lambda x, k: F.struct(x.alias("x"), k.cast("int").alias("k")))
    )
    found = found.withColumn(
        "s",
        F.when(F.size(F.array_distinct("h")) < F.size("h"), ranked).otherwise(
            F.array().cast("array<struct<x:bigint,k:int>>")
        ),
    ).drop("h")
    # In hash order, a window is repeated if a neighbour has the same hash.
    twice = F.filter(
        "s",
        lambda v, k: F.coalesce(F.get("s", k - 1)["x"] == v["x"], F.lit(False))
        | F.coalesce(F.get("s", k + 1)["x"] == v["x"], F.lit(False)),
    )
    found = found.withColumn("at", F.array_sort(F.transform(twice, lambda v: v["k"]))).drop("s")
    # A filter of the caller must not be pushed below this line: it would put the arrays above
    # inside their own lambdas.  No filter on the output of a generator passes it.
    counts = F.struct(*COUNTS[:-1], _repeated(F.col("at")).cast("long").alias(COUNTS[-1]))
    return found.select("doc_id", F.inline(F.array(counts)))


def _share(part: Column, whole: Column) -> Column:
    """Whole parts per thousand, 0 of nothing."""
    return F.coalesce(F.try_divide(part * 1000, whole).cast("long"), F.lit(0).cast("long"))


def ratios(stats: DataFrame) -> DataFrame:
    """Adds the base verdict and the junk ratios of all rules."""
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    return stats.withColumns(
        {
            "base_failed": failed,
            "symbol_share": _share(F.col("n_symbols"), F.col("word_chars")),
            "dup_line_share": _share(F.col("n_dup_lines"), F.col("n_lines")),
            "repeat_share": _share(F.col("n_repeat_words"), F.col("n_words")),
            "stutter_share": _share(F.col("n_stutters"), F.col("n_words")),
        }
    )


def binomial_tail(successes: Column, trials: Column, p: float) -> Column:
    """P(X <= successes) for X binomial, summed term by term in logarithms."""
    odds = F.lit(p / (1 - p))
    first = trials * F.log1p(F.lit(-p))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), successes),
        F.struct(first.cast("double").alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, k: F.struct(
            (acc["term"] + F.coalesce(F.log((trials - k) / (k + 1) * odds), F.lit(float("-inf")))).alias("term"),
            (acc["sum"] + F.exp(acc["term"])).alias("sum"),
        ),
    )
    return F.least(total["sum"], F.lit(1.0))


def proven_cutoffs(holdout: DataFrame, control: Control = Control()) -> DataFrame:
    """(stratum, rule columns): the strictest proven cutoff, null without proof.

    ``holdout`` has a stratum, the ratios and a boolean ``good`` for each labelled document.
    """
    rule = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("share")) for r in RULES])
    )
    cut = F.explode(F.array(*[F.lit(c).cast("long") for c in control.cutoffs])).alias("cutoff")
    rows = holdout.filter("good").select("stratum", rule.alias("r")).select("stratum", "r.*", cut)
    counts = rows.groupBy("stratum", "rule", "cutoff").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("share") > F.col("cutoff")).alias("x")
    )
    strata = holdout.filter("good").agg(F.countDistinct("stratum").alias("strata"))
    level = F.lit(control.error) / (F.col("strata") * len(RULES))
    risk = control.risk / len(RULES)
    # From the mean on the tail is at least one half, so its long sum need not be made.
    open_ = (level >= 0.5) | (F.col("x") < F.ceil(F.col("n") * F.lit(risk)))
    tested = counts.crossJoin(F.broadcast(strata)).filter(  # one row
        F.when(open_, binomial_tail(F.col("x"), F.col("n"), risk) <= level)
    )
    return tested.groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{r}_cutoff") for r in RULES]
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    label: str = "quality",
    control: Control = Control(),
) -> DataFrame:
    """One row per document: counts, base verdict, ratios, cutoffs in force and ``kept``.

    A null text counts as empty and fails the base rules.  A null stratum is a stratum of its own.
    Labels without id or value, and ids with two different labels, prove nothing.
    Repeated documents are judged each.  Without labels only the base rules hold.
    Every labelled text counts for the proof, once in each stratum; copies that are labelled differently prove
    nothing.  An empty table of documents gives no rows.  Whole texts are counted, whatever their length; other
    columns of both tables, whatever their names, are left out.
    """
    group = F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")
    known = columns(labels, doc_id, label).filter(
        F.col(doc_id).isNotNull() & F.col(label).isNotNull()
    )
    known = known.groupBy(doc_id).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    known = known.filter(F.col("low") == F.col("high"))
    known = known.select(F.col(doc_id).alias("doc_id"), (F.col("low") > 0).alias("good"))

    texts = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), group)
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("digest")
    # Stratum and digest travel in the key, so that statistics() sees one id column.
    keyed = texts.select(F.struct("doc_id", "stratum", digest).alias("doc_id"), "text")
    # Written once for proof and verdict: labels meet counts, no text is read twice or shuffled.
    judged = written(ratios(statistics(keyed)))
    judged = judged.withColumns({"stratum": F.col("doc_id.stratum"), "digest": F.col("doc_id.digest")})
    judged = judged.withColumn("doc_id", F.col("doc_id.doc_id"))
    trials = judged.select("doc_id", "stratum", "digest", *RULES).join(known, "doc_id")
    trials = trials.groupBy("stratum", "digest").agg(
        F.min("good").alias("good"), F.max("good").alias("any_good"), *[F.max(r).alias(r) for r in RULES]
    )
    cutoffs = proven_cutoffs(trials.filter("good = any_good"), control)

    judged = judged.join(cutoffs, "stratum", "left")
    above = F.lit(False)
    for r in RULES:
        above = above | F.coalesce(F.col(r) > F.col(f"{r}_cutoff"), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~above).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "stratum", "n_lines", "n_stutters", *RULES,
        *[f"{r}_cutoff" for r in RULES],
    )


def oracle(control: Control = Control()) -> str:
    """The same in DuckDB SQL."""
    cutoffs = ", ".join(map(str, control.cutoffs))
    shares = {
        "symbol_share": ("n_symbols", "word_chars"),
        "dup_line_share": ("n_dup_lines", "n_lines"),
        "repeat_share": ("n_repeat_words", "n_words"),
        "stutter_share": ("n_stutters", "n_words"),
    }
    ratio = ", ".join(
        f"CASE WHEN {b} = 0 THEN 0 ELSE ({a} * 1000) // {b} END::BIGINT AS {r}"
        for r, (a, b) in shares.items()
    )
    pivot = ", ".join(f"min(cutoff) FILTER (rule = '{r}') AS {r}_cutoff" for r in RULES)
    above = " OR ".join(f"coalesce({r} > {r}_cutoff, false)" for r in RULES)
    unpivot = " UNION ALL ".join(
        f"SELECT stratum, '{r}' AS rule, {r} AS share FROM holdout" for r in RULES
    )
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS stratum
  FROM documents
), split AS (
  SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM base
), spots AS (
  SELECT row_no, unnest(range(1, len(w) - {WINDOW - 2})) AS k FROM split
), windows AS (
  SELECT s.row_no, p.k, s.w[p.k : p.k + {WINDOW - 1}] AS gram FROM spots p JOIN split s USING (row_no)
), twice AS (
  SELECT row_no, k FROM windows
  QUALIFY count(*) OVER (PARTITION BY row_no, gram) > 1
), covered AS (
  SELECT row_no, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT row_no, unnest(range(k, k + {WINDOW})) AS j FROM twice) GROUP BY row_no
), stats AS (
  SELECT row_no, doc_id, stratum, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1]))::BIGINT AS n_stutters,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, text
  FROM split LEFT JOIN covered USING (row_no)
), judged AS (
  SELECT *, (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}) AS base_failed,
    {ratio}
  FROM stats
), known AS (
  SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL
  GROUP BY doc_id HAVING min(quality) = max(quality)
), holdout AS (
  SELECT stratum, {", ".join(f"any_value({r}) AS {r}" for r in RULES)}
  FROM judged JOIN known USING (doc_id)
  GROUP BY stratum, text HAVING bool_and(good)
), shares AS ({unpivot}
), counts AS (
  SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (share > cutoff) AS x
  FROM shares CROSS JOIN (SELECT unnest([{cutoffs}]) AS cutoff) GROUP BY ALL
), tested AS (
  SELECT * FROM counts
  WHERE list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
      + i * ln({control.risk / len(RULES)!r}) + (n - i) * ln(1 - {control.risk / len(RULES)!r}))))
    <= {control.error!r} / ((SELECT count(DISTINCT stratum) FROM holdout) * {len(RULES)})
), cutoffs AS (
  SELECT stratum, {pivot} FROM tested GROUP BY stratum
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({above}) AS kept, stratum, n_lines, n_stutters, {", ".join(RULES)},
  {", ".join(f"{r}_cutoff::BIGINT AS {r}_cutoff" for r in RULES)}
FROM judged LEFT JOIN cutoffs USING (stratum)
"""
