"""URL filter: rules first, then a ratio of character language models.

A rule fits its host and all subdomains of it where the url's path starts with the rule's path; the
longest fitting rule decides. Urls that no rule decides are judged by two variable-order Markov models,
one of urls that rules allow and one of urls that rules block. Each interpolates the orders 0 to ORDER
by Witten-Bell smoothing: what a context has not seen backs off to the next shorter one, down to the
uniform distribution of bytes. The score is the difference of the two log-likelihoods over the url's
length; a url is allowed where it reaches the threshold that best separates the calibration fold, a
fifth of the decided urls that the models do not learn from.

All distinct urls that rules decide are learnt from or calibrate; the hash of a url says which. Contexts and
followers are counted by the tasks and summed by a shuffle into a table of one row a distinct run of ORDER + 1
bytes, from which the shorter ones follow. A table of at most RUNS rows, as counted, is sent to the tasks; a longer
one is joined: probabilities are derived order by order for the distinct runs of all urls, where no context has
more than 256 followers, and summed over the runs of each distinct url. Scores are the same but for the last bits.
The threshold comes from counts of scores in steps of 1 / STEPS, over the whole fold.
Without urls of both verdicts to learn from models are equal, and without calibration urls of both the
threshold is 0. A null or empty url has no host, path or rule and scores 0. Repeated rows are judged alike. Empty tables give empty
results. Other columns are never read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, batches_of, materialise, table

#: (rule, verdict). A rule is a host and, from its first slash on, a path.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
ORDER = 5
STEPS = 1 << 14
#: Distinct runs of ORDER + 1 bytes that a model sent to the tasks holds at most (24 bytes each); more are joined.
RUNS = 1 << 20
#: A run that stands in at least this share of all distinct runs of urls is joined by broadcast: there are at most as many.
HOT_SHARE = 512
#: Copies of each score that the rows of a url are dealt over.
SALT = 16
_FOLD = 5  # one in so many decided urls calibrates
_EDGE = 1  # stands before a url's first byte and behind its last


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def ruled(pages: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """page_id, url, host, path, and rule and verdict of the longest rule that fits (else null)."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules or RULES, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rows.select("*", rule.alias("rule"), verdict.alias("verdict"))


def _grams(urls: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order, context and next byte of every place packed into an integer; the url of each place; the urls' lengths."""
    lead = bytes([_EDGE]) * ORDER
    raw = np.frombuffer(b"".join(lead + u + lead[:1] for u in urls), np.uint8).astype(np.uint64)
    lengths = np.array([len(u) + 1 for u in urls], np.int64)
    ends = np.cumsum(lengths + ORDER)
    place = np.arange(int(lengths.sum())) + np.repeat(ORDER * (np.arange(len(urls)) + 1), lengths)
    keys, key = [], np.zeros(len(place), np.uint64)
    for k in range(ORDER + 1):
        key = key | (raw[place - k] << np.uint64(8 * k))
        keys.append(key)
    assert not len(urls) or ends[-1] == len(raw)
    return keys, np.repeat(np.arange(len(urls)), lengths), lengths


class Markov:
    """Counts of contexts and of their followers for the orders 0 to ORDER."""

    def __init__(self, urls: list[bytes]):
        self._build(*np.unique(_grams(urls)[0][ORDER], return_counts=True))

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Markov:
        """The model of distinct packed runs of ORDER + 1 bytes and their counts."""
        out = cls.__new__(cls)
        order = np.argsort(keys)
        out._build(keys[order], counts[order])
        return out

    def _build(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.runs, self.tables = (keys, counts), []
        for k in range(ORDER + 1):
            seen, at = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(at, counts, len(seen)).astype(np.int64)
            context, first = np.unique(seen >> np.uint64(8), return_index=True)
            self.tables.append((seen, n, context, np.add.reduceat(n, first) if len(n) else n, np.diff(np.append(first, len(seen)))))

    def __reduce__(self):
        return Markov.of, self.runs

    def log_probability(self, keys: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(keys[0]), 1 / 256)
        for key, (seen, n, context, total, kinds) in zip(keys, self.tables, strict=True):
            if not len(seen):
                continue
            at = np.minimum(np.searchsorted(seen, key), len(seen) - 1)
            count = np.where(seen[at] == key, n[at], 0)
            before = key >> np.uint64(8)
            at = np.minimum(np.searchsorted(context, before), len(context) - 1)
            known = context[at] == before
            p = np.where(known, (count + kinds[at] * p) / (total[at] + kinds[at]), p)
        return np.log(p)


def threshold(low: np.ndarray, high: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The cut between ranges of scores that best separates counts of good and bad urls; 0 without one of them."""
    if not good.sum() or not bad.sum():
        return 0.0
    cuts = np.concatenate([[low[0] - 1e-9], (low[1:] + high[:-1]) / 2, [high[-1] + 1e-9]])
    right = 1 - np.concatenate([[0], np.cumsum(good)]) / good.sum() + np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(cuts[best[len(best) // 2]])


class UrlModel:
    def __init__(self, allowed: list[bytes], blocked: list[bytes]):
        fold = lambda urls, test: [u for k, u in enumerate(urls) if (k % 5 == 4) == test]
        both = bool(allowed and blocked)
        self.allowed, self.blocked = Markov(fold(allowed, False) if both else []), Markov(fold(blocked, False) if both else [])
        good, bad = self.score(fold(allowed, True)), self.score(fold(blocked, True))
        marks, at = np.unique(np.concatenate([good, bad]), return_inverse=True)
        self.threshold = threshold(marks, marks, *(np.bincount(x, minlength=len(marks)) for x in (at[: len(good)], at[len(good) :]))) if both else 0.0

    @classmethod
    def of(cls, keys: np.ndarray, allowed: np.ndarray, blocked: np.ndarray) -> UrlModel:
        """The model of the runs of ORDER + 1 bytes of urls of both verdicts, with the threshold 0."""
        out = cls([], [])
        if allowed.any() and blocked.any():
            out.allowed, out.blocked = (Markov.of(keys[n > 0], n[n > 0]) for n in (allowed, blocked))
        return out

    def score(self, urls: list[bytes | None]) -> np.ndarray:
        """Difference of the log-likelihoods over the length; 0 for null and empty urls."""
        clean = [u or b"" for u in urls]
        if not clean:
            return np.empty(0)
        keys, url, lengths = _grams(clean)
        gap = self.allowed.log_probability(keys) - self.blocked.log_probability(keys)
        return np.where([bool(u) for u in clean], np.bincount(url, gap, len(clean)) / lengths, 0.0)


def _tally(batches, values):
    """Sums of a batch: each distinct value of its urls, and how often it stands in allowed and in blocked ones."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            value, url = values(batches_of(batch, "url"))
            allowed = np.array([v == "allow" for v in batch.column(1).to_pylist()], bool)[url]
            seen, at = np.unique(value, return_inverse=True)
            n = np.bincount(at[allowed], minlength=len(seen)), np.bincount(at[~allowed], minlength=len(seen))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (seen, *n)], ["value", "allowed", "blocked"])


def _runs(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, url, _ = _grams(urls)
    return keys[ORDER], url


def _steps(urls: list[bytes], model: UrlModel) -> tuple[np.ndarray, np.ndarray]:
    return np.floor(model.score(urls) * STEPS), np.arange(len(urls))


def _summed(urls: DataFrame, values) -> DataFrame:
    """value, allowed and blocked over all urls."""
    each = urls.mapInArrow(partial(_tally, values=values), "value long, allowed long, blocked long")
    return each.groupBy("value").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))


def _columns(sums: DataFrame) -> list[np.ndarray]:
    """The columns of a small table in the order of values."""
    got = sums.toArrow()
    order = np.argsort(got.column(0).to_numpy())
    return [c.to_numpy()[order] for c in got.columns]


def _calibrates() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(_FOLD)) == _FOLD - 1


def _decided(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("verdict").isNotNull() & (F.length("url") > 0)).select("url", "verdict").distinct()


def count_runs(rows: DataFrame) -> DataFrame:
    """How often each run of ORDER + 1 bytes stands in allowed and in blocked urls that do not calibrate."""
    return materialise(_summed(_decided(rows).filter(~_calibrates()), _runs), "runs")


def fit_urls(rows: DataFrame, runs: DataFrame | None = None) -> UrlModel:
    """A model in memory of all distinct urls that rules decide; runs are their counts, if at hand."""
    value, allowed, blocked = _columns(count_runs(rows) if runs is None else runs)
    model = UrlModel.of(value.astype(np.uint64), allowed, blocked)
    if len(model.allowed.runs[0]):
        step, good, bad = _columns(_summed(_decided(rows).filter(_calibrates()), partial(_steps, model=model)))
        model.threshold = threshold(step / STEPS, (step + 1) / STEPS, good, bad)
    return model


def _places(batches):
    """The distinct runs of each url and how often it holds them."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            urls = batches_of(batch, "url")
            value, url = _runs(urls)
            order = np.lexsort((value, url))
            value, url = value[order], url[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(value.astype(np.int64)) != 0) | (np.diff(url) != 0)])) if len(url) else url
            n, lengths = np.diff(np.append(first, len(url))), np.array([len(u) + 1 for u in urls], np.int64)
            columns = [batch.column("digest").take(pa.array(url[first])), pa.array(value[first].astype(np.int64)), pa.array(n / lengths[url[first]])]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "value", "share"])


def _gaps(universe: DataFrame) -> DataFrame:
    """value and gap, the difference of the log-probabilities, of every run in a table of value, allowed and blocked.

    From the shortest suffixes up: the probability of a run needs that of its suffix and the counts of its context's
    followers, of which there are at most 256, so no key is hot."""
    levels = [universe.select(F.col("value").alias("key"), "allowed", "blocked")]
    for k in range(ORDER - 1, -1, -1):
        tail = F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        levels.append(levels[-1].groupBy(tail.alias("key")).agg(*[F.sum(c).alias(c) for c in ("allowed", "blocked")]))
    known = None
    for k, level in enumerate(reversed(levels)):
        context = Window.partitionBy(F.shiftright("key", 8))
        stats = {f"{c}_{what}": f.over(context) for c in ("allowed", "blocked") for what, f in (("total", F.sum(c)), ("kinds", F.count_if(F.col(c) > 0)))}
        here = level.withColumns(stats)
        if known is None:
            here = here.withColumns({"allowed_p": F.lit(1 / 256), "blocked_p": F.lit(1 / 256)})
        else:
            shorter = known.withColumnRenamed("key", "tail").hint("merge")
            here = here.withColumn("tail", F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(shorter, "tail")
        p = {c: F.when(F.col(f"{c}_total") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_p")) / (F.col(f"{c}_total") + F.col(f"{c}_kinds"))).otherwise(F.col(f"{c}_p")) for c in ("allowed", "blocked")}
        known = materialise(here.select("key", *[v.alias(f"{c}_p") for c, v in p.items()]), "chances")
    return known.select(F.col("key").alias("value"), (F.log("allowed_p") - F.log("blocked_p")).alias("gap"))


def _joined_scores(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """digest (md5) and score of each distinct url that is not empty, by joins alone."""
    urls = rows.filter(F.length("url") > 0).select("url").distinct().select("url", F.md5("url").alias("digest"))
    places = materialise(urls.mapInArrow(_places, "digest string, value long, share double"), "places")
    asked = materialise(places.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "asked")
    none = [F.lit(0).cast("long").alias(c) for c in ("allowed", "blocked")]
    universe = runs.unionByName(asked.select("value", *none)).groupBy("value").agg(*[F.sum(c).alias(c) for c in ("allowed", "blocked")])
    gaps = _gaps(universe)
    total = asked.agg(F.sum("n")).first()[0] or 0
    hot = asked.filter(F.col("n") * HOT_SHARE >= max(total, HOT_SHARE)).select("value")
    hot_gaps = F.broadcast(materialise(gaps.join(F.broadcast(hot), "value", "left_semi"), "hot"))
    cold = places.join(hot_gaps.select("value"), "value", "left_anti").join(gaps.hint("merge"), "value")
    both = cold.unionByName(places.join(hot_gaps, "value"), allowMissingColumns=False)
    return materialise(both.groupBy("digest").agg(F.sum(F.col("share") * F.col("gap")).alias("score")), "scores")


def _judge_by_joins(rows: DataFrame, runs: DataFrame) -> DataFrame:
    scores = _joined_scores(rows, runs)
    marked = _decided(rows).filter(_calibrates()).select(F.md5("url").alias("digest"), "verdict").join(scores.hint("merge"), "digest")
    says = {"allowed": F.count_if(F.col("verdict") == "allow"), "blocked": F.count_if(F.col("verdict") != "allow")}
    step, good, bad = _columns(marked.groupBy(F.floor(F.col("score") * STEPS).alias("value")).agg(*[c.alias(n) for n, c in says.items()]))
    cut = threshold(step / STEPS, (step + 1) / STEPS, good, bad)
    dealt = scores.select("digest", "score", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    asked = rows.withColumns({"digest": F.md5("url"), "salt": F.pmod(F.spark_partition_id(), F.lit(SALT))})
    # rows without a url have no digest to be dealt by: they go past the join
    empty = F.coalesce(F.length("url"), F.lit(0)) == 0
    scored = asked.filter(~empty).join(dealt.hint("merge"), ["digest", "salt"], "left").unionByName(asked.filter(empty).withColumn("score", F.lit(0.0)))
    verdict = F.coalesce("verdict", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def _judge(batches, model: UrlModel):
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            score = model.score(batches_of(batch, "url"))
            said = batch.column(4).to_pylist()
            verdict = [v or ("allow" if s >= model.threshold else "block") for v, s in zip(said, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdict), pa.array(score)], ["page_id", "host", "path", "rule", "verdict", "score"])


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, most_runs: int = RUNS) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every url."""
    rows = ruled(pages, rules)
    runs = count_runs(rows)
    n, allowed, blocked = runs.agg(F.count(F.lit(1)), F.sum("allowed"), F.sum("blocked")).first()
    if n > most_runs and allowed and blocked:
        return _judge_by_joins(rows, runs)
    # without both verdicts the models are empty, however many the runs
    model = fit_urls(rows, runs) if allowed and blocked else UrlModel([], [])
    asked = rows.select("page_id", "host", "path", "rule", "verdict", "url")
    return asked.mapInArrow(partial(_judge, model=model), "page_id long, host string, path string, rule string, verdict string, score double")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
