"""Quality rules with controlled risk, in DataFrame functions alone.

Base counts of every text feed a few ratio rules of the form "reject at or above a cutoff".
The cutoffs come from labelled documents. Within a stratum (a language, say) a rule has the share
WEIGHTS of ``alpha`` and of the level: its cutoffs are tried from lax to strict, each tested for "rejects
more than ``alpha * weight`` of the good documents" with the exact binomial tail, at the level
``delta * weight / strata``, until one fails. Testing a fixed sequence needs no further correction, and
the rest is Bonferroni's, so with probability ``1 - delta`` all strata together reject at most the share
``alpha`` of their good documents by these rules, whichever cutoff is taken of those that pass. The
labels choose it: a rule acts if its strictest safe cutoff rejects any document labelled bad, and halfway
between that cutoff and the laxest that rejects as many. Where labels are too few for any guarantee, or
none is bad, a rule stays silent.

Defined cases: a null or empty text has no words and fails the base rule; a null label is no
label; of several labels of a document the lowest counts; documents of an unlabelled or null
stratum meet the base rule only; without documents the result is empty. Columns of the input
that clash with the counts are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialise

SPACE = " \t\n\x0b\x0c\r"
SPACES = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")
#: name: (numerator, denominator); scores are whole per mille of the ratio, at most 1000.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
}
#: Each rule's share of the risk and of the level; the first needs fewer labels than the others to act.
WEIGHTS = {"symbols": 0.5, "capitals": 0.125, "marks": 0.125, "repeated_lines": 0.125, "repeated_words": 0.125}
#: Scores are tested in steps of this many per mille.
STEP = 20


def _drop(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeated(words: Column, n: Column) -> Column:
    """Words that lie in a window of three words which the text holds at least twice.

    Windows are sorted by a 64-bit hash so that equal ones are neighbours; the positions of
    those are sorted again, and each adds the words up to the next, three at most.
    """
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    return F.when(n >= 4, windows)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts of every whole text."""
    base = docs.drop(*[c for c in docs.columns if c in COUNTS])
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(SPACE))
    out = base.withColumn("__words", F.when(F.length(trimmed) > 0, F.split(trimmed, SPACES)).otherwise(F.array().cast("array<string>")))
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "__sorted": F.sort_array(_repeated(F.col("__words"), F.size("__words"))),
        "__lines": F.filter(F.split(whole, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0),
        "__chars": F.length(whole),
    })
    s = F.col("__sorted")
    hit = F.filter(
        F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])),
        lambda x: x.isNotNull(),
    )
    out = out.withColumn("__hits", F.sort_array(hit))
    h = F.col("__hits")
    out = out.withColumns({
        "word_chars": F.length(_drop(whole, SPACE)).cast("long"),
        "n_symbols": (F.col("__chars") - F.length(_drop(whole, SYMBOLS))).cast("long"),
        "n_capitals": (F.col("__chars") - F.length(_drop(whole, CAPITALS))).cast("long"),
        "n_marks": (F.col("__chars") - F.length(_drop(whole, "!?;:"))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.coalesce(
            F.aggregate(F.transform(h, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(h, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b), F.lit(0)
        ).cast("long"),
    })
    # Counts pass through a generator, past which no filter moves: else Catalyst would put the
    # whole expressions into each filter on them and evaluate them again for every mention.
    return out.select(*base.columns, F.inline(F.array(F.struct(*COUNTS))))


def score(rule: str) -> Column:
    top, bottom = (F.col(c) for c in RULES[rule])
    return F.when(bottom > 0, F.least(F.lit(1000), F.floor(1000 * top / bottom))).otherwise(F.lit(0)).cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, rate: Column | float) -> Column:
    """P(X <= k) of n trials at ``rate``, summed term by term in logarithms."""
    rate = F.lit(rate) if isinstance(rate, float) else rate
    odds = F.log(rate / (1.0 - rate))
    first = F.struct((n * F.log(1.0 - rate)).alias("term"), F.exp(n * F.log(1.0 - rate)).alias("total"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1).cast("double") / i) + odds
        return F.struct(term.alias("term"), (state["total"] + F.exp(term)).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, first, add, lambda s: F.least(F.lit(1.0), s["total"]))


def cutoffs(counted: DataFrame, labels: DataFrame, stratum: str, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected, n_bad): the cutoff of each rule that acts, and what it rejects.

    ``counted`` has doc_id, the stratum and the base counts. What is gathered are counts by
    stratum, rule and score step, whatever the number of labelled documents.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") >= 1).alias("__good"))
    scored = counted.where(~base_failed() & F.col(stratum).isNotNull()).select("doc_id", F.col(stratum).alias("stratum"), F.array(*[F.struct(F.lit(r).alias("rule"), F.ceil(score(r) / STEP).cast("int").alias("step")) for r in RULES]).alias("__s"))
    steps = materialise(
        scored.join(known, "doc_id").select("stratum", "__good", F.explode("__s").alias("s")).groupBy("stratum", "s.rule", "s.step").agg(F.count_if("__good").alias("n"), F.count_if(~F.col("__good")).alias("b")), "steps"
    )
    strata = max(1, steps.select("stratum").distinct().count())
    # One row for every tested cutoff, 1000 / STEP at most, with the labelled documents at or above it.
    by = Window.partitionBy("stratum", "rule")
    strict = by.orderBy(F.desc("step"))
    dense = (
        steps.groupBy("stratum", "rule").agg(F.map_from_entries(F.collect_list(F.struct("step", F.struct("n", "b")))).alias("m"), F.sum("n").alias("n_good"))
        .withColumn("step", F.explode(F.sequence(F.lit(1000 // STEP), F.lit(1), F.lit(-1))))
        .withColumn("n_rejected", F.sum(F.coalesce(F.try_element_at("m", "step")["n"], F.lit(0))).over(strict))
        .withColumn("n_bad", F.sum(F.coalesce(F.try_element_at("m", "step")["b"], F.lit(0))).over(strict))
    )
    weight = F.create_map(*[F.lit(x) for r in RULES for x in (r, WEIGHTS[r])])[F.col("rule")]
    tested = dense.withColumn("passes", binomial_tail(F.col("n_rejected"), F.col("n_good"), alpha * weight) <= delta * weight / strata)
    safe = tested.withColumn("unbroken", F.min(F.col("passes").cast("int")).over(strict)).where("unbroken = 1")
    # Of the safe ones those that reject as many bad documents as the strictest does.
    useful = safe.withColumn("most", F.max("n_bad").over(by)).where("most > 0 and n_bad = most")
    middle = useful.withColumn("middle", F.floor((F.min("step").over(by) + F.max("step").over(by)) / 2)).where("step = middle")
    return middle.select("stratum", "rule", (F.col("step") * STEP - STEP + 1).alias("cutoff"), "n_good", "n_rejected", "n_bad")


#: Strata up to which the cutoffs are sent to every task; with more, a join by stratum is planned.
BROADCAST_STRATA = 2000


def judge(counted: DataFrame, chosen: DataFrame, stratum: str) -> DataFrame:
    """Add base_failed, the rules that reject (``broken``) and kept."""
    table = materialise(chosen.groupBy(F.col("stratum").alias("__stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cut")), "cutoffs")
    small = table.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    joined = counted.drop("base_failed", "kept", "broken").join(F.broadcast(table) if small else table, F.col(stratum) == F.col("__stratum"), "left")
    broken = F.filter(F.array(*[F.when(score(r) >= F.col("__cut").getItem(r), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return (
        joined.withColumn("base_failed", base_failed()).withColumn("broken", broken)
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop("__stratum", "__cut")
    )


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, broken, kept; counted once."""
    counted = materialise(with_counts(docs.select("doc_id", stratum, "text")).drop("text"), "counts")
    return judge(counted, cutoffs(counted, labels, stratum, alpha, delta), stratum)


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The documents that all rules let pass, with the columns of ``docs``.

    The counts are written beside the whole rows, so each text is counted once and none is shuffled.
    """
    marked = docs.select(F.struct(*docs.columns).alias("__row"), F.col(stratum).alias("__by"), "doc_id", "text")
    counted = materialise(with_counts(marked).drop("text"), "counted")
    return judge(counted, cutoffs(counted, labels, "__by", alpha, delta), "__by").where("kept").select("__row.*")


def verdicts_sql(alpha: float = 0.05, delta: float = 0.05) -> str:
    """The same verdicts in SQL over the views ``documents`` and ``labels``, by language."""
    scores = " UNION ALL ".join(
        f"SELECT doc_id, lang, base_failed, '{r}' AS rule, {WEIGHTS[r]!r}::DOUBLE AS weight, CASE WHEN {b} > 0 THEN least(1000, floor(1000 * {a} / {b})) ELSE 0 END AS score FROM counted" for r, (a, b) in RULES.items()
    )
    order = ", ".join(f"'{r}'" for r in RULES)
    return f"""
WITH split AS (SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM split WHERE len(words) >= 3),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id),
sizes AS (SELECT doc_id, lang, len(words) AS n_words, length(regexp_replace(text, '[ \\t-\\r]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
 len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, length(text) - length(regexp_replace(text, '[!?;:]', '', 'g')) AS n_marks FROM split),
counted AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (SELECT s.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM sizes s LEFT JOIN covered USING (doc_id))),
scores AS ({scores}),
known AS (SELECT doc_id, min(quality) >= 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT lang, rule, weight, good, ceil(score / {STEP}) AS step FROM scores JOIN known USING (doc_id) WHERE NOT base_failed AND lang IS NOT NULL),
tried AS (SELECT lang, rule, weight, s AS step, count(*) FILTER (good) AS n, count(*) FILTER (good AND held.step >= s) AS k, count(*) FILTER (NOT good AND held.step >= s) AS bad FROM held, range(1, {1000 // STEP + 1}) r(s) GROUP BY ALL),
tested AS (SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r} * weight) + (n - i) * ln(1 - {alpha!r} * weight))) FROM range(0, k + 1) r(i)) <= {delta!r} * weight / (SELECT count(DISTINCT lang) FROM held) AS passes FROM tried),
safe AS (SELECT *, max(bad) OVER (PARTITION BY lang, rule) AS most FROM (SELECT *, bool_and(passes) OVER (PARTITION BY lang, rule ORDER BY step DESC) AS unbroken FROM tested) WHERE unbroken),
cutoffs AS (SELECT lang, rule, (floor((min(step) + max(step)) / 2) - 1) * {STEP} + 1 AS cutoff FROM safe WHERE most > 0 AND bad = most GROUP BY ALL),
broken AS (SELECT doc_id, string_agg(rule, ',' ORDER BY list_position([{order}], rule)) AS broken FROM scores JOIN cutoffs USING (lang, rule) WHERE score >= cutoff GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken IS NULL AS kept, coalesce(broken, '') AS broken FROM counted LEFT JOIN broken USING (doc_id)"""
