"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posterior labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import batch, by_bytes, small_batches
from .tokens import forget

#: Insults, abuse and threats by language, one voter each list.
LEXICONS = {
    "en_person": "idiot moron loser clown scum imbecile cretin dumbass jerk scumbag lowlife bastard",
    "en_quality": "stupid worthless pathetic disgusting useless dumb vile repulsive despicable trash garbage",
    "en_profane": "fuck fucking shit bullshit bitch asshole damn crap",
    "en_threat": "kill die hurt destroy murder",
    "de": "idiot trottel depp arschloch dummkopf wichser miststück abschaum wertlos widerlich erbärmlich dumm",
    "fr": "idiot imbécile connard abruti crétin salaud ordure minable pathétique stupide débile dégoûtant",
    "es": "idiota imbécil estúpido basura escoria cabrón gilipollas patético inútil asqueroso payaso",
}
WORDS = re.compile(r"[^\W\d_]+")
SECOND_PERSON = frozenset("you your youre du dein ihr tu toi vous tú usted".split())
PATTERNS = ("two_insults", "four_insults", "insult_near_you", "shouted_insult")
MINED_VOTERS = 40
#: Lengths of a word's beginnings that also count as features, marked by a star.
STEMS = range(3, 9)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)), F.lit(0)) == 0


def apart(mined: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """The mined words of which none begins another one: beginnings of one word would vote many times over."""
    out: list[tuple[str, bool]] = []
    for w, toxic in mined:
        root = w.rstrip("*")
        if not any(root.startswith(o) or o.startswith(root) for o in (x.rstrip("*") for x, _ in out)):
            out.append((w, toxic))
    return out


class Voters:
    """Votes and features of a text. ``words`` (mined, toxic first, with sign) and lexicon words are
    features by presence; lexicons, patterns and the strongest mined words vote."""

    def __init__(self, mined: list[tuple[str, bool]]):
        listed = sorted({w for words in LEXICONS.values() for w in words.split()})
        self.features = [*listed, *(w for w, _ in mined if w not in set(listed)), *PATTERNS]
        self.index = {w: i for i, w in enumerate(self.features)}
        self.lexicons = [np.array([self.index[w] for w in words.split()]) for words in LEXICONS.values()]
        #: feature and whether it votes toxic
        self.single = [(self.index[w], toxic) for w, toxic in apart(mined)[:MINED_VOTERS]]
        self.insults = frozenset(listed) - frozenset(LEXICONS["en_threat"].split()) | {w for w, toxic in mined if toxic}
        self.known: dict[str, tuple[bool, tuple[int, ...]]] = {}
        self.names = [*LEXICONS, *PATTERNS, "no_insult", *(self.features[i] for i, _ in self.single)]
        #: what every voter votes for: 1 toxic, 0 clean
        self.polarity = np.array([1] * (len(LEXICONS) + len(PATTERNS)) + [0] + [int(t) for _, t in self.single])

    def of_word(self, word: str) -> tuple[bool, tuple[int, ...]]:
        """Whether the word is an insult, and its features."""
        names = [n for n in (word, *(word[:k] + "*" for k in STEMS if len(word) > k)) if n in self.index]
        return any(n in self.insults for n in names), tuple(self.index[n] for n in names)

    def found(self, text: str | None) -> list[int]:
        """Features present in the whole text, ascending."""
        if len(self.known) > 200_000:
            self.known.clear()
        known, words, hits, out = self.known, WORDS.findall((text or "").lower()), [], set()
        for w in set(words):
            if w not in known:
                known[w] = self.of_word(w)
            if known[w][1]:
                out.update(known[w][1])
                if known[w][0]:
                    hits.append(w)
        if len(hits) > 1:
            out.add(self.index["two_insults"])
        if len(hits) > 3:
            out.add(self.index["four_insults"])
        if hits:
            at = [i for i, w in enumerate(words) if known[w][0]]
            if any(not SECOND_PERSON.isdisjoint(words[max(0, i - 3):i + 4]) for i in at):
                out.add(self.index["insult_near_you"])
            if not {w.upper() for w in hits}.isdisjoint(WORDS.findall(text)):
                out.add(self.index["shouted_insult"])
        return sorted(out)

    def votes(self, found: list[int]) -> int:
        """Bit j: voter j votes (for its own side); else it abstains."""
        has, bits = set(found), 0
        insult = any(self.features[i] in self.insults for i in has)
        cast = [any(i in has for i in lex.tolist()) for lex in self.lexicons]
        cast += [self.index[p] in has for p in PATTERNS]
        cast += [not insult]
        cast += [i in has for i, _ in self.single]
        for j, v in enumerate(cast):
            bits |= int(v) << j
        return bits


def mine_words(docs: DataFrame, labels: DataFrame, fit_rows: int, keep: int = 400, least: int = 3) -> list[tuple[str, bool]]:
    """Words and word beginnings whose presence goes with the label in a hash sample of at most about ``fit_rows`` labelled,
    not held-out rows, the most telling first, each with the side that it speaks for."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, fit_rows / max(1, n))
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # bounded by fit_rows rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(few.select(F.col("doc_id").cast("long"), "toxic")), "doc_id")
    split = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))
    rows = rows.select("toxic", F.filter(split, lambda w: F.length(w) <= 40).alias("words"))
    stems = F.flatten(F.transform("words", lambda w: F.transform(F.filter(F.array(*map(F.lit, STEMS)), lambda k: k < F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k), F.lit("*")))))
    rows = cut_lineage(rows.select("toxic", F.array_distinct(F.concat("words", stems)).alias("words")))
    n1, n0 = (r or 0 for r in rows.agg(F.sum((F.col("toxic") == 1).cast("long")), F.sum((F.col("toxic") == 0).cast("long"))).first())
    if not n1 or not n0:
        return []
    count = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum(F.col("toxic")).alias("k1"), F.count("*").alias("k"))
    p1, p0 = F.col("k1") / n1, (F.col("k") - F.col("k1")) / n0
    mean = F.col("k") / (n1 + n0)
    z = (p1 - p0) / F.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0) + 1e-9)
    best = count.where(F.col("k") >= least).select("word", z.alias("z")).where("abs(z) > 4.5").orderBy(F.abs("z").desc(), "word").limit(keep).collect()
    return [(r.word, r.z > 0) for r in best]


FOUND = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(pa.int32())), ("votes", pa.int64())])


def vote_table(docs: DataFrame, voters: Voters) -> DataFrame:
    """``doc_id, found, votes`` of every row's whole text: one narrow pass."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            found = [voters.found(t) for _, run in by_bytes(b.column(1)) for t in run]
            yield batch(FOUND, [b.column(0), found, [voters.votes(f) for f in found]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(vote, "doc_id long, found array<int>, votes long")


class LabelModel:
    """Two classes; given the class every voter votes or abstains. Correlated voters share their weight.

    ``rate[y, j]`` is the chance that voter j votes on class y, ``share[j]`` its weight after
    dividing by one plus its correlations with the others inside the classes. A voter that abstains says nothing: most
    are of another language. ``scale`` and ``shift`` fit the log-odds to known labels.
    """

    def __init__(self, polarity: np.ndarray, strength: float = 20.0, prior: float = 0.1):
        m = len(polarity)
        # belief before any data: a voter speaks far more often on its own side
        self.base = np.where(polarity == 1, np.array([[0.01], [0.15]]), np.array([[0.5], [0.05]]))
        self.strength, self.pi, self.rate, self.share = strength, prior, self.base.copy(), np.ones(m)
        self.first_pi, self.scale, self.shift = prior, 1.0, 0.0

    def log_odds(self, bits: np.ndarray) -> np.ndarray:
        return np.log(self.pi / (1 - self.pi)) + bits @ ((np.log(self.rate[1]) - np.log(self.rate[0])) * self.share)

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        """P(toxic) of rows of a 0/1 matrix of votes."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.log_odds(bits) + self.shift, -40, 40)))

    def calibrate(self, bits: np.ndarray, truth: np.ndarray, least: int = 20) -> LabelModel:
        """Scale and shift of the log-odds by logistic regression on rows with known labels, ``least`` of either at least."""
        if min((truth == 1).sum(), (truth == 0).sum()) >= least:
            w, c = fit_linear(self.log_odds(bits)[:, None], truth, penalty=1e-3)
            if w[0] > 0:
                self.scale, self.shift = float(w[0]), c
        return self

    def fit(self, patterns: DataFrame, rounds: int = 12) -> LabelModel:
        """EM over ``votes, toxic, n`` of all documents; where ``toxic`` is known it is the truth.

        Every round is one pass over the counted patterns; tasks return sums only.
        """
        m = self.rate.shape[1]
        width = 2 + 2 * m + 2 * m * m
        for i in range(rounds):
            model, full = self, i >= rounds - 2

            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(width)
                for b in batches:
                    votes, n = b.column(0).to_numpy(), b.column(2).to_numpy().astype(float)
                    bits = (votes[:, None] >> np.arange(m) & 1).astype(float)
                    known = np.array([np.nan if x is None else x for x in b.column(1).to_pylist()], float)
                    p = np.where(np.isnan(known), model.posterior(bits), known)
                    for y, w in ((0, (1 - p) * n), (1, p * n)):
                        total[y] += w.sum()
                        total[2 + y * m:2 + (y + 1) * m] += w @ bits
                        if full:
                            total[2 + 2 * m + y * m * m:2 + 2 * m + (y + 1) * m * m] += ((bits * w[:, None]).T @ bits).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

            got = np.sum([r.sums for r in patterns.select("votes", "toxic", "n").mapInArrow(sums, "sums array<double>").collect()] or [np.zeros(width)], axis=0)
            size, voted = got[:2], got[2:2 + 2 * m].reshape(2, m)
            self.pi = float(np.clip((size[1] + self.first_pi * 10) / (size.sum() + 10), 1e-4, 0.9))
            self.rate = np.clip((voted + self.base * self.strength) / (size[:, None] + self.strength), 1e-6, 1 - 1e-6)
            if full:
                both = got[2 + 2 * m:].reshape(2, m, m)
                self.share = 1 / (1 + self._correlation(size, voted, both))
        return self

    def _correlation(self, size: np.ndarray, voted: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Sum of each voter's clear correlations with others, inside the classes, weighed by class size."""
        rho = np.zeros(both.shape[1:])
        for y in (0, 1):
            if size[y] > 1:
                mean = voted[y] / size[y]
                sd = np.sqrt(mean * (1 - mean)) + 1e-6
                rho += size[y] / size.sum() * np.abs(both[y] / size[y] - np.outer(mean, mean)) / np.outer(sd, sd)
        np.fill_diagonal(rho, 0)
        return np.where(rho > 0.1, rho, 0).sum(axis=1)


def fit_linear(x: np.ndarray, p: np.ndarray, penalty: float = 1.0, steps: int = 25, block: int = 512) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps; the last column is the constant.

    Only ``block`` rows at a time are held as floats.
    """
    width = x.shape[1] + 1
    w, ridge = np.zeros(width), np.r_[np.full(width - 1, penalty), 1e-3]
    for _ in range(steps):
        grad, hess = ridge * w, np.diag(ridge)
        for a in range(0, len(x), block):
            now = np.hstack([x[a:a + block].astype(float), np.ones((len(x[a:a + block]), 1))])
            q = 1 / (1 + np.exp(-np.clip(now @ w, -30, 30)))
            grad += now.T @ (q - p[a:a + block])
            hess += (now * (q * (1 - q) + 1e-6)[:, None]).T @ now
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


class Model:
    def __init__(self, voters: Voters, labels: LabelModel, weights: np.ndarray, constant: float):
        self.voters, self.labels, self.weights, self.constant = voters, labels, weights, constant

    def score(self, found: list[list[int]]) -> list[float]:
        w, c = self.weights, self.constant
        z = np.array([c + w[f].sum() if f else c for f in found], float)
        return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).tolist()


def fit_table(got: pa.Table, width: int, voters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows ``found, votes, toxic``: 0/1 matrices of the features and of the votes, a byte a cell, and the labels (unknown: NaN)."""
    got = got.combine_chunks()
    x, truth = np.zeros((got.num_rows, width), bool), got["toxic"].to_numpy().astype(float)
    at = 0
    for found in got["found"].chunks:
        many = np.diff(found.offsets.to_numpy())
        x[np.repeat(np.arange(at, at + len(found)), many), found.flatten().to_numpy()] = True
        at += len(found)
    votes = got["votes"].to_numpy()
    bits = np.zeros((got.num_rows, voters), np.uint8)
    for j in range(voters):
        bits[:, j] = votes >> j & 1
    return x, bits, truth


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> tuple[Model, DataFrame]:
    """The model and the stored votes of all rows.

    Words are mined on a hash sample of about ``fit_rows`` labelled rows. The classifier is fit on the label model's
    posteriors of two hash samples of about ``fit_rows`` rows each, of the labelled and of the unlabelled, so that
    neither crowds the other out; a known label is its own posterior, as in the EM. Held-out rows are in none.
    The label model counts the votes of all documents. Without labels the voters' prior beliefs start the EM.
    """
    voters = Voters(mine_words(docs, labels, fit_rows))
    with small_batches(docs.sparkSession):
        votes = cut_lineage(vote_table(docs, voters))
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    joined = votes.select("doc_id", "votes").join(known, "doc_id", "left")
    patterns = cut_lineage(joined.groupBy("votes", "toxic").agg(F.count("*").alias("n")))
    model = LabelModel(voters.polarity).fit(patterns)

    open_rows = votes.where(~held_out()).join(known, "doc_id", "left")
    sizes = open_rows.agg(F.count("toxic"), F.count("*") - F.count("toxic")).first()
    many = [int(min(1.0, fit_rows / max(1, n)) * (1 << 30)) for n in sizes]
    few = open_rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.when(F.col("toxic").isNotNull(), many[0]).otherwise(many[1]))
    # bounded by twice fit_rows rows of a few numbers; they come and stay packed, for the driver's sake
    x, bits, truth = fit_table(few.select("found", "votes", "toxic").toArrow(), len(voters.features), len(voters.polarity))
    sure = ~np.isnan(truth)
    model.calibrate(bits[sure], truth[sure])
    p = np.where(sure, truth, model.posterior(bits)) if len(truth) else np.zeros(0)
    if p.sum() < 1 or (1 - p).sum() < 1:
        # nothing to tell apart: insults count as the prior beliefs say
        w, c = np.array([4.0 if f in voters.insults else 0.0 for f in voters.features]), -3.0
    else:
        w, c = fit_linear(x, p)
    return Model(voters, model, w, c), votes


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """``doc_id, held_out, score, predicted, posterior`` of every row, from its whole text.

    Null and empty texts score as texts without any feature. Equal rows stay. An empty table gives no
    rows. Languages, sources, ids and labels are not read by a score.
    """
    model, votes = fit(docs, labels, fit_rows)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("posterior", pa.float64())])
    m = len(model.voters.polarity)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = (b.column(2).to_numpy()[:, None] >> np.arange(m) & 1).astype(float)
            yield batch(out, [b.column(0), model.score(b.column(1).to_pylist()), model.labels.posterior(bits).tolist()])

    scored = votes.select("doc_id", "found", "votes").mapInArrow(score, "doc_id long, score double, posterior double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "posterior")


def clean_only(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """The rows that are not predicted toxic, with their columns: one more narrow pass over the texts."""
    model, _ = fit(docs, labels, fit_rows)

    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            yield b.filter(pa.array([s < 0.5 for _, run in by_bytes(b.column(at)) for s in model.score([model.voters.found(t) for t in run])], pa.bool_()))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(keep, docs.schema)
