"""Quality by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). The corpus is reduced to counts of vote
patterns, at most 3 to the number of rules; expectation-maximisation over that small table
estimates how often each rule's votes say bad on good and on bad documents, as one fold in
SQL; a document is kept if its posterior of being good is a half or more.

Two classes alone may settle on any split of the corpus, a topic or a format as well as
quality. Three things hold the estimates to what the rules mean: prior votes worth a share of
the cast ones; a bad vote is always at least ODDS times as likely on a bad document as on a
good one; and no rule is taken to find more than MOST_FOUND of the bad ones, as a document may
be bad in one way only. At least LEAST_SHARE of all documents are taken to be good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import settle

SEPARATORS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = 5
ROUNDS = 25
#: Shares of bad votes on good and on bad documents, and of good documents, to start from.
START_FALSE, START_FOUND, START_SHARE = 0.05, 0.3, 0.8
#: Prior votes of each class for each vote that a rule casts.
PRIOR = 0.05
#: A bad vote is this many times as likely on bad documents, at least; bounds of the shares.
ODDS, LEAST_FALSE, MOST_FOUND, LEAST_SHARE = 4.0, 0.001, 0.5, 0.7

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> dict[str, Column]:
    """The voting rules over the counted columns."""
    words, symbols = F.col("n_words"), _share("n_symbols", "word_chars")
    mean, lines = _share("word_chars", "n_words"), _share("n_dup_lines", "__lines")
    repeats, capitals = _share("n_repeat_words", "n_words"), _share("__capitals", "word_chars")
    letters, kinds = _share("__letters", "word_chars"), _share("__kinds", "n_words")
    return {
        "length": _vote(words < 10, words >= 40),
        "symbols": _vote(symbols > 0.05, symbols < 0.01),
        "word_size": _vote((mean < 2.5) | (mean > 14), (mean >= 3.5) & (mean <= 9)),
        "lines": _vote(lines > 0.3, (F.col("n_dup_lines") == 0) & (F.col("__lines") >= 2)),
        "repeats": _vote(repeats > 0.15, repeats < 0.01),
        "capitals": _vote(capitals > 0.3, capitals < 0.12),
        "letters": _vote(letters < 0.75, letters > 0.9),
        "variety": _vote((kinds < 0.1) & (words >= 20), (kinds > 0.3) & (words >= 20)),
        "ending": _vote(F.lit(False), F.col("__ended")),
    }


def counted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the base counts (long) and the helper counts that the rules read, over whole texts."""
    text = F.col("__text")
    without = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SEPARATORS, "") != "")
    run = lambda i: F.xxhash64(*(F.get("__words", i + k) for k in range(RUN)))
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.size("__words") - RUN, F.lit(0))), run)
    # Windows found twice or more: neighbours in hash order; their places give the words they cover.
    at = lambda k: F.get(F.col("__sorted"), k)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("__sorted") - 1), lambda k: (at(k) == at(k - 1)) | (at(k) == at(k + 1)))
    starts = F.sort_array(F.transform(twice, lambda k: F.get(F.col("__sorted"), k)["i"]))
    steps = F.transform(F.sequence(F.lit(1), F.size("__starts")), lambda k: F.coalesce(F.least(F.lit(RUN), F.get("__starts", k) - F.get("__starts", k - 1)), F.lit(RUN)))
    covered = F.aggregate(steps, F.lit(0), lambda a, b: a + b)
    out = (
        df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
        .withColumns({"__words": F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), "__rows": lines})
        .withColumn("__hashes", F.when(F.size("__words") >= RUN, hashes))
        .withColumn("__sorted", F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .withColumn("__starts", F.when(F.col("__sorted").isNotNull(), starts))
        .withColumns(
            {
                "n_words": F.size("__words").cast("long"),
                "word_chars": F.char_length(F.translate(text, SEPARATORS, "")).cast("long"),
                "n_symbols": without(SYMBOLS).cast("long"),
                "n_dup_lines": (F.size("__rows") - F.size(F.array_distinct("__rows"))).cast("long"),
                "n_repeat_words": F.when(F.col("__starts").isNotNull(), covered).otherwise(0).cast("long"),
                "__lines": F.size("__rows").cast("long"),
                "__capitals": without(CAPITALS).cast("long"),
                "__letters": F.char_length(F.regexp_replace(text, r"\P{L}+", "")).cast("long"),
                "__kinds": F.size(F.array_distinct("__words")).cast("long"),
                "__ended": F.rtrim(text).rlike(r"[.!?…][\"'”»)]?$"),
            }
        )
    )
    return out.drop("__text", "__words", "__rows", "__hashes", "__sorted", "__starts")


def voted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the base counts, base_failed and the rules' votes (__votes)."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    seen = counted(df, text_col).withColumns({"base_failed": failed, "__votes": F.array(*rules().values())})
    return seen.drop("__lines", "__capitals", "__letters", "__kinds", "__ended")


def estimated(votes: DataFrame) -> list[float]:
    """The model from the __votes of all rows: for each rule the share of bad ones among its votes on
    good documents, then for each that among its votes on bad ones, then the share of good documents.

    One fold over ROUNDS rounds: posteriors of every pattern, then each rule's expected votes
    in both classes with the prior's. Where the two shares come too close or change places,
    both move to ODDS apart, and the rule's bad votes as a whole stay as many as they are.
    Rules without votes keep their start values.
    """
    n = len(rules())
    pattern = F.array_sort(F.collect_list(F.struct(F.col("__votes").alias("v"), F.col("count").cast("double").alias("c"))))
    model = votes.groupBy("__votes").count().agg(pattern.alias("patterns"))

    def rates(seen: Column, j: Column) -> Column:
        """struct(false, found) of rule j."""

        def add(a: Column, p: Column) -> Column:
            vote, good, bad = F.get(p["v"], j), p["c"] * p["q"], p["c"] * (1 - p["q"])
            more = lambda name, when, x: (a[name] + F.when(when, x).otherwise(0.0)).alias(name)
            return F.struct(more("ng", vote != 0, good), more("xg", vote == -1, good), more("nb", vote != 0, bad), more("xb", vote == -1, bad))

        def settled(t: Column) -> Column:
            prior = F.lit(PRIOR) * (t["ng"] + t["nb"]) + 1
            false, found = (t["xg"] + prior * START_FALSE) / (t["ng"] + prior), (t["xb"] + prior * START_FOUND) / (t["nb"] + prior)
            apart = (t["xg"] + t["xb"] + prior * (START_FALSE + START_FOUND)) / (t["ng"] + prior + ODDS * (t["nb"] + prior))
            mixed = found < ODDS * false
            found = F.least(F.when(mixed, ODDS * apart).otherwise(found), F.lit(MOST_FOUND))
            return F.struct(F.greatest(F.least(F.when(mixed, apart).otherwise(false), found / ODDS), F.lit(LEAST_FALSE)).alias("false"), found.alias("found"))

        zero = F.lit(0.0)
        return F.aggregate(seen, F.struct(zero.alias("ng"), zero.alias("xg"), zero.alias("nb"), zero.alias("xb")), add, settled)

    def round_(m: Column, _: Column) -> Column:
        seen = F.transform("patterns", lambda p: F.struct(p["v"].alias("v"), p["c"].alias("c"), _posterior(p["v"], m).alias("q")))
        total = lambda rows, value: F.aggregate(rows, F.lit(0.0), lambda a, p: a + value(p))

        def after(seen: Column) -> Column:
            each = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: rates(seen, j))
            share = (total(seen, lambda p: p["c"] * p["q"]) + START_SHARE) / (total(seen, lambda p: p["c"]) + 1)
            share = F.greatest(share, F.lit(LEAST_SHARE))
            return F.concat(F.transform(each, lambda r: r["false"]), F.transform(each, lambda r: r["found"]), F.array(share))

        return F.get(F.transform(F.array(seen), after), F.lit(0))

    start = F.array(*[F.lit(START_FALSE)] * n, *[F.lit(START_FOUND)] * n, F.lit(START_SHARE))
    return list(model.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_).alias("m")).first().m)


def _posterior(votes: Column, model: Column) -> Column:
    """Probability that a document with these votes is good."""
    n = len(rules())
    false, found, share = (lambda j: F.get(model, j)), (lambda j: F.get(model, j + n)), F.get(model, F.lit(2 * n))
    says = lambda v, j: F.when(v == 1, F.log((1 - false(j)) / (1 - found(j)))).when(v == -1, F.log(false(j) / found(j))).otherwise(0.0)
    odds = F.aggregate(F.transform(votes, says), F.log(share / (1 - share)), lambda a, b: a + b)
    return 1 / (1 + F.exp(-odds))


def quality(df: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """df with the base counts, base_failed, p_good (posterior) and kept.

    A null text counts as empty and fails the base rules, as any text under ten words does.
    Rows are judged one by one, so ties and repeated rows get equal verdicts; an empty table
    gives none; input columns of the new names are replaced. keep_text=False leaves the text
    out of what is written between the two passes and out of the result.
    """
    table = voted(df, text_col)
    table = settle(table if keep_text else table.drop(text_col))
    model = estimated(table)
    posterior = _posterior(F.col("__votes"), F.array(*map(F.lit, model)))
    return table.withColumn("p_good", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)).drop("__votes")


def op8_query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(documents, keep_text=False).select("doc_id", *BASE, "base_failed", "kept", "p_good")
