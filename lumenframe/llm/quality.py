"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0). The rules' accuracies are
not given: expectation-maximisation finds them from how the rules agree over
the whole corpus, and a document's posterior probability of being good decides
instead of a demand that all rules pass. The corpus enters the fit as counts
of vote patterns, at most 3 ** len(RULES) rows whatever its size.

Words are runs without ASCII white space. Defined cases: a null or empty text
has no words and fails the base check; all rows of equal text get equal
results; columns named like a result are replaced; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.catalog import query
from lumenframe.llm.rows import documents
from lumenframe.session import cut

WINDOW = 5
BLOCK = 250
ROUNDS = 30
SPACE = " \t\n\x0b\f\r"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_distinct_words", "n_block_distinct", "n_upper", "n_exclaims", "n_sentences", "n_lines"]

# Rules whose distinct words are counted anew in every block of BLOCK words, summed over all blocks: the share of
# distinct words in a whole text falls with its length, however good it is. Passages that come again far apart are
# the matter of the rule "repeats".
BLOCKWISE = {"variety"}
# Rule: (when it votes bad, when it votes good; None: never). Ratios are written as products.
RULES: dict[str, tuple[str, str | None]] = {
    "symbols": ("10 * n_symbols > n_words", None),
    "shouting": ("10 * n_upper > 3 * word_chars", None),
    "exclamations": ("10 * n_exclaims > n_words", None),
    "repeats": ("6 * n_repeat_words > n_words", None),
    "same_lines": ("10 * n_dup_lines > 3 * n_lines", None),
    "variety": ("20 * n_distinct_words < 9 * n_words", "10 * n_distinct_words > 6 * n_words"),
    "word_length": ("2 * word_chars < 7 * n_words OR 2 * word_chars > 13 * n_words",
                    "word_chars BETWEEN 4.2 * n_words AND 6.2 * n_words"),
    "sentences": ("50 * n_sentences < n_words", "n_words BETWEEN 3 * n_sentences AND 25 * n_sentences"),
}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def block_distinct(words: Column, k: int = BLOCK) -> Column:
    """Sum of the distinct words of consecutive blocks of ``k`` words; the last block may be shorter."""
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(words) - 1, F.lit(0)) / k).cast("int"))
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + F.size(F.array_distinct(F.slice(words, b * k + 1, F.lit(k)))))


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words inside windows of ``k`` that occur twice or more in the row."""
    def covered(windows: Column) -> Column:
        # Equal windows become neighbours; their places, in order, cover up to k new words each.
        order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        def places(s: Column) -> Column:
            same = lambda j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            twice = F.filter(s, lambda x, j: same(j - 1, x) | same(j + 1, x))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-k).alias("at"), F.lit(0).cast("long").alias("n"))
        count = F.aggregate(let(order, places), start, lambda s, i: F.struct(
            i.alias("at"), (s["n"] + F.least(F.lit(k), i - s["at"])).alias("n")))["n"]
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(count)
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(words) < k, F.lit(0).cast("long")).otherwise(let(hashes(words), covered))


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts that the rules read and base_failed."""
    raw = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(raw, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    counts = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        block_distinct(w).alias("n_block_distinct"), repeated_words(w).alias("n_repeat_words")))
    full = let(F.filter(F.split(raw, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""), lambda x: F.struct(
        F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("distinct")))
    left = lambda drop: F.char_length(F.regexp_replace(raw, F.lit(drop), F.lit(""))).cast("long")
    out = df.drop(*BASE, *MORE, "base_failed").withColumns({"_w": counts, "_l": full})
    return out.withColumns({
        "n_words": F.col("_w.n_words"), "n_distinct_words": F.col("_w.n_distinct_words"),
        "n_block_distinct": F.col("_w.n_block_distinct"),
        "n_repeat_words": F.col("_w.n_repeat_words"),
        "word_chars": left("[\\x20\\x09-\\x0D]+"),
        "n_symbols": left("[^#*$%&|<>]+"),
        "n_upper": left("[^\\p{Lu}]+"),
        "n_exclaims": left("[^!]+"),
        "n_sentences": F.regexp_count(raw, F.lit("[.!?](?![^\\x20\\x09-\\x0D])")).cast("long"),
        "n_lines": F.col("_l.n"), "n_dup_lines": F.col("_l.n") - F.col("_l.distinct"),
    }).withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")).drop("_w", "_l")


def votes(rules=None) -> Column:
    """Votes of all rules as an array of -1, 0, 1."""
    def condition(name: str, rule: str) -> Column:
        return F.expr(rule.replace("n_distinct_words", "n_block_distinct") if name in BLOCKWISE else rule)
    return F.array(*[F.when(condition(name, bad), F.lit(-1)).when(condition(name, good) if good else F.lit(False), F.lit(1)).otherwise(F.lit(0))
                     for name, (bad, good) in (rules or RULES).items()])


def label_model(featured: DataFrame, rules=None, rounds: int = ROUNDS) -> DataFrame:
    """(votes, n, posterior, prior, good, bad): one row per vote pattern.

    The model is two classes in which rules vote independently: good[k] and
    bad[k] are rule k's probabilities of -1, 0 and 1 in a class, smoothed by
    one imagined vote each. The first guess trusts every rule: a document with
    a bad vote is bad with probability 0.9. Rounds then move documents whose
    other votes speak against it, and with them the rules' accuracies. All
    rounds run inside one expression over the pattern list.
    """
    k = len(rules or RULES)
    counted = featured.groupBy(votes(rules).alias("votes")).agg(F.count(F.lit(1)).alias("n"))
    patterns = counted.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    guess = """transform(patterns, p -> named_struct('votes', p.votes, 'n', p.n, 'q',
        CASE WHEN array_contains(p.votes, -1) THEN 0.1D ELSE 0.9D END))"""

    def shares(weight: str) -> str:
        return f"""transform(sequence(0, {k - 1}), k -> transform(array(-1, 0, 1), v ->
            (1 + aggregate(e, 0D, (t, p) -> t + CASE WHEN p.votes[k] = v THEN {weight} ELSE 0D END))
            / (3 + aggregate(e, 0D, (t, p) -> t + {weight}))))"""
    fit = f"""named_struct(
        'prior', (1 + aggregate(e, 0D, (t, p) -> t + p.n * p.q)) / (2 + aggregate(e, 0D, (t, p) -> t + p.n)),
        'good', {shares('p.n * p.q')}, 'bad', {shares('p.n * (1 - p.q)')})"""
    expect = f"""transform(array({fit}), m -> transform(e, p -> named_struct('votes', p.votes, 'n', p.n, 'q',
        1 / (1 + exp(-aggregate(sequence(0, {k - 1}), ln(m.prior / (1 - m.prior)), (t, k) ->
            t + ln(m.good[k][p.votes[k] + 1] / m.bad[k][p.votes[k] + 1])))))))[0]"""
    rows = patterns.withColumn("e", F.expr(f"aggregate(sequence(1, {rounds}), {guess}, (e, i) -> {expect})"))
    return (rows.withColumn("m", F.expr(fit)).withColumn("p", F.explode("e"))
            .select("p.votes", "p.n", F.col("p.q").alias("posterior"), "m.prior", "m.good", "m.bad"))


def judge(featured: DataFrame, rules=None, threshold: float = 0.5) -> DataFrame:
    """``featured`` with posterior and kept."""
    model = label_model(featured, rules).select(F.col("votes").alias("_votes"), "posterior")
    # At most 3 ** rules patterns, so the table is always small.
    judged = featured.drop("posterior", "kept").withColumn("_votes", votes(rules)).join(F.broadcast(model), "_votes", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= threshold)).drop("_votes")


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that are kept, columns unchanged. Text is never shuffled: the
    counts are computed once for the fit and once for the verdict."""
    named = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return judge(features(named)).filter("kept").select("_row.*")


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base check and verdict of every document."""
    counted = cut(features(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    return judge(counted).select("doc_id", *BASE, "base_failed", "kept", "posterior")
