"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer turns words into classes (insult, threat, target, negation, report, clause end);
small transducers for negation, reported speech and targets rewrite and weigh them. Their composition
is one table, which runs over all clauses of a batch at once. The lexicon is a base list and stems
that the labelled rows show to be typical of toxic texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import kernel
from corvane.llm.tables import keep, table

BASE = {
    "insult": "idiot idiots idiotic moron morons stupid dumb dumbass loser losers scum trash clown pathetic worthless disgusting imbecile cretin retard bastard jerk vermin filth scumbag "
    "trottel dummkopf idiotin vollidiot versager abschaum widerlich arschloch "
    "imbécile crétin débile ordure minable abruti connard salaud "
    "idiota imbécil estúpido estúpida basura inútil asqueroso asquerosa cretino",
    "threat": "kill murder strangle stab slaughter exterminate lynch behead umbringen töten abstechen tuer égorger massacrer matar asesinar degollar",
    "target": "you your yours yourself u he him she her they them these those people women men immigrants jews muslims christians "
    "du dich dir ihr euch sie er tu te toi vous ils elles eux il elle tú ti usted ustedes ellos ellas",
    "negation": "not no never isn aren wasn don doesn didn won wouldn cannot neither nor nicht kein keine keiner nie niemals pas jamais aucun aucune nunca jamás tampoco",
    "report": "said says say saying claimed claims called calls quoted wrote writes alleged reportedly sagte sagt behauptet schrieb dit disait affirme écrit dijo dice afirma escribió",
}
ENDS = {"sentence": ". ! ? !! ?? !? ... … .\" !\" ?\" .) !) ?)", "clause": ", ; : – — ,\" ;\" ( )"}
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, CLAUSE, SENTENCE, AIMED, LATE, DENIED, QUOTED, MENACED = range(13)
N_CLASSES = 13
STEM_LENGTHS = (4, 5, 6, 7, 8)
STEM_WEIGHT, MIN_TOXIC_DOCS, MIN_RATIO, MIN_LLR, MAX_TRAIN = 0.75, 6, 20.0, 40.0, 20_000
PER_DOC = 3
NEGATION_REACH, REPORT_REACH, TARGET_REACH = 3, 12, 5
BEFORE, AFTER = 16, 8
THRESHOLD, DENSITY = 1.25, 1.5


class Transducer:
    """A deterministic weighted transducer: arcs[state][symbol] = (next state, output, weight). Symbols
    without an arc copy themselves and follow `default` (state -> state)."""

    def __init__(self, arcs: dict[int, dict[int, tuple[int, int, float]]], default: dict[int, int]) -> None:
        n = 1 + max(default)
        self.next = np.zeros((n, N_CLASSES), np.int64)
        self.out = np.tile(np.arange(N_CLASSES), (n, 1))
        self.weight = np.ones((n, N_CLASSES))
        for s in range(n):
            self.next[s] = default[s]
            for symbol, (to, out, weight) in arcs.get(s, {}).items():
                self.next[s, symbol], self.out[s, symbol], self.weight[s, symbol] = to, out, weight

    def compose(self, other: Transducer) -> Transducer:
        """First self, then other, over its output; weights multiply. Only reachable states are made."""
        ids, todo, rows = {(0, 0): 0}, [(0, 0)], []
        while todo:
            a, b = todo.pop(0)
            row = []
            for symbol in range(N_CLASSES):
                mid = self.out[a, symbol]
                to = (int(self.next[a, symbol]), int(other.next[b, mid]))
                if to not in ids:
                    ids[to] = len(ids)
                    todo.append(to)
                row.append((ids[to], int(other.out[b, mid]), self.weight[a, symbol] * other.weight[b, mid]))
            rows.append(row)
        made = Transducer({}, {i: 0 for i in range(len(rows))})
        table = np.array(rows)
        made.next, made.out, made.weight = table[..., 0].astype(np.int64), table[..., 1].astype(np.int64), table[..., 2]
        return made


def _fading(trigger: int, reach: int, rewrite: dict[int, tuple[int, float]], resets: tuple[int, ...], once: bool = False) -> Transducer:
    """After `trigger`, for `reach` symbols (or up to the first rewritten one), rewrite[symbol] = (output, weight)."""
    arcs: dict[int, dict[int, tuple[int, int, float]]] = {}
    for s in range(reach + 1):
        after = max(0, s - 1)
        arcs[s] = {trigger: (reach, trigger, 1.0)} | {r: (0, r, 1.0) for r in resets}
        if s:
            arcs[s] |= {k: (0 if once else after, out, w) for k, (out, w) in rewrite.items()}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(reach + 1)})


def grammar() -> Transducer:
    """negation o reported speech o target before o target of a threat o target of an insult. What is left
    in class INSULT or THREAT is a bare match, AIMED has its target before it in the clause, MENACED is
    the target that follows a threat, LATE one that follows an insult."""
    ends = (CLAUSE, SENTENCE)
    negation = _fading(NEGATION, NEGATION_REACH, {INSULT: (DENIED, 1.0), THREAT: (DENIED, 1.0)}, ends)
    report = _fading(REPORT, REPORT_REACH, {INSULT: (QUOTED, 0.4), THREAT: (QUOTED, 0.4)}, (SENTENCE,))
    before = _fading(TARGET, TARGET_REACH, {INSULT: (AIMED, 1.0), THREAT: (AIMED, 2.0)}, ends)
    threatened = _fading(THREAT, TARGET_REACH, {TARGET: (MENACED, 1.0)}, ends, once=True)
    after = _fading(INSULT, TARGET_REACH, {TARGET: (LATE, 1.0)}, ends)
    return negation.compose(report).compose(before).compose(threatened).compose(after)


#: Score of an output class, times the word's own weight (LATE and MENACED: as it is).
SCORE = np.zeros(N_CLASSES)
SCORE[[INSULT, AIMED, LATE, QUOTED, THREAT, MENACED]] = (0.85, 1.25, 0.25, 0.85, 0.4, 2.1)


@dataclass
class Lexicon:
    """Hashes of words and word beginnings, sorted; class and weight of each."""

    words: np.ndarray
    classes: np.ndarray
    stems: dict[int, np.ndarray]

    @classmethod
    def base(cls, stems: dict[int, np.ndarray] | None = None) -> Lexicon:
        found: dict[int, int] = {}
        for symbol, text in ((REPORT, BASE["report"]), (NEGATION, BASE["negation"]), (TARGET, BASE["target"]), (THREAT, BASE["threat"]), (INSULT, BASE["insult"]), (CLAUSE, ENDS["clause"]), (SENTENCE, ENDS["sentence"])):
            for word in text.split():
                found[kernel.word_hash(word)] = symbol
        keys = np.array(sorted(found), np.uint64)
        return cls(keys, np.array([found[int(k)] for k in keys]), stems or {})

    def strong(self) -> np.ndarray:
        return self.words[np.isin(self.classes, (INSULT, THREAT))]


def _bits(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
    return bits


def score_texts(texts: list[str | None], lexicon: Lexicon, machine: Transducer, stretch: int = int(THRESHOLD * 1000 / DENSITY)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score, number of matched clauses, words, greatest score of `stretch` words in a row) of each text."""
    tokens = kernel.tokenize(texts, punctuation=True, prefixes=tuple(lexicon.stems))
    n = len(tokens.hash)
    score, clauses, densest = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts))
    hit = np.zeros(n, bool)
    strength = np.ones(n)
    strong = lexicon.strong()
    some = np.flatnonzero(_bits(strong)[(tokens.hash >> np.uint64(44)).astype(np.int64)])
    hit[some[np.isin(tokens.hash[some], strong)]] = True
    stem = np.zeros(n, bool)
    for k, known in lexicon.stems.items():
        h = tokens.prefix.get(k, np.empty(0, np.uint64))
        some = np.flatnonzero(_bits(known)[(h >> np.uint64(44)).astype(np.int64)])
        stem[some[np.isin(h[some], known)]] = True
    stem &= ~hit
    strength[stem] = STEM_WEIGHT
    at = np.flatnonzero(hit | stem)
    if not len(at):
        return score, clauses, tokens.counts, densest
    # stretches of words around the hits, within their texts; the automaton forgets faster than that
    offsets = tokens.offsets
    low = np.maximum(at - BEFORE, offsets[tokens.doc[at]])
    high = np.minimum(at + AFTER + 1, offsets[tokens.doc[at] + 1])
    new = np.concatenate([[True], (low[1:] > high[:-1]) | (tokens.doc[at[1:]] != tokens.doc[at[:-1]])])
    low, high = low[new], high[np.concatenate([new[1:], [True]])]
    length = high - low
    order = np.argsort(-length, kind="stable")
    low, length = low[order], length[order]
    inside = np.repeat(low - (np.cumsum(length) - length), length) + np.arange(length.sum())
    classes = np.zeros(n, np.int64)
    place = np.minimum(np.searchsorted(lexicon.words, tokens.hash[inside]), len(lexicon.words) - 1)
    classes[inside] = np.where(lexicon.words[place] == tokens.hash[inside], lexicon.classes[place], OTHER)
    classes[stem] = INSULT
    state = np.zeros(len(low), np.int64)
    worth = np.zeros(n)
    for step in range(int(length[0])):
        live = int(np.searchsorted(-length, -step, side="left"))
        i = low[:live] + step
        s, c = state[:live], classes[i]
        out = machine.out[s, c]
        worth[i] = SCORE[out] * machine.weight[s, c] * np.where((out == LATE) | (out == MENACED), 1.0, strength[i])
        state[:live] = machine.next[s, c]
    got = np.flatnonzero(worth > 0)
    np.add.at(score, tokens.doc[got], worth[got])
    ends = np.cumsum((classes == CLAUSE) | (classes == SENTENCE))
    seen = np.unique(np.stack([tokens.doc[got], ends[got]]), axis=1)
    np.add.at(clauses, seen[0], 1)
    # the stretch that ends with each match, within its text
    upto = np.concatenate([[0], np.cumsum(worth[got])])
    begin = np.searchsorted(got, np.maximum(got - stretch + 1, offsets[tokens.doc[got]]))
    np.maximum.at(densest, tokens.doc[got], upto[1:] - upto[begin])
    return score, clauses, tokens.counts, densest


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for labels, texts in ((b.column(0).slice(low, high - low), texts) for b in batches for low, high, texts in kernel.chunks(b.column(1))):
        toxic = labels.to_numpy(zero_copy_only=False) >= 0.5
        tokens = kernel.tokenize(texts, prefixes=(3, *STEM_LENGTHS))
        words = np.array([len(tokens.doc) - toxic[tokens.doc].sum(), toxic[tokens.doc].sum()])
        cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for k, above in zip(STEM_LENGTHS, (3, *STEM_LENGTHS)):
            own = np.flatnonzero(tokens.prefix[k])
            h, parent, doc = tokens.prefix[k][own], tokens.prefix[above][own], tokens.doc[own]
            distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
            pairs, times = np.unique(which * len(toxic) + doc, return_counts=True)
            of, bad = pairs // len(toxic), toxic[pairs % len(toxic)]
            times = np.minimum(times, PER_DOC)
            counts = (np.bincount(of, x, len(distinct)).astype(np.int64) for x in (times * bad, times * ~bad, bad))
            values = (np.full(len(distinct), k), distinct.view(np.int64), parent[first].view(np.int64), *counts)
            for c, v in zip(cols, values):
                c.append(v)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c).astype(np.int64)) for c in cols)], ["k", "stem", "parent", "toxic", "clean", "docs"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([int(words[1])], pa.int64()), pa.array([int(words[0])], pa.int64()), pa.array([0], pa.int64())], ["k", "stem", "parent", "toxic", "clean", "docs"])


def _near_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of a text's 3-word shingles: mostly equal for near copies."""
    for batch, low, texts in ((b, low, texts) for b in batches for low, _, texts in kernel.chunks(b.column(1))):
        h, doc = kernel.shingles(kernel.tokenize(texts), 3)
        least = np.full(len(texts), 2**64 - 1, np.uint64)
        np.minimum.at(least, doc, h)
        yield pa.RecordBatch.from_arrays([*(c.slice(low, len(texts)) for c in batch.columns), pa.array(least.view(np.int64))], ["toxic", "text", "near"])


def _clean_counts(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for texts in (texts for b in batches for _, _, texts in kernel.chunks(b.column(1))):
            tokens = kernel.tokenize(texts, prefixes=tuple(wanted))
            ks, stems, counts = [], [], []
            for k, known in wanted.items():
                h = tokens.prefix.get(k, np.empty(0, np.uint64))
                some = np.flatnonzero(_bits(known)[(h >> np.uint64(44)).astype(np.int64)])
                some = some[np.isin(h[some], known)]
                pairs, times = np.unique(np.searchsorted(known, h[some]) * len(texts) + tokens.doc[some], return_counts=True)
                n = np.bincount(pairs // len(texts), np.minimum(times, PER_DOC), len(known)).astype(np.int64)
                ks.append(np.full(len(known), k))
                stems.append(known.view(np.int64))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (ks, stems, counts)], ["k", "stem", "clean"])

    return run


def learn_stems(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict[int, np.ndarray]:
    """Word beginnings of 4 to 8 letters that are MIN_RATIO times as frequent in toxic texts as in
    others, with a log-likelihood ratio of MIN_LLR, and in MIN_TOXIC_DOCS of the toxic ones; only the
    shortest of those that contain each other; copies of one text count once. A document counts at most PER_DOC times for a stem. Of more than max_train labelled rows, those of the least hash of doc_id count."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).dropna().groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    chosen = F.broadcast(keep(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "labels"))
    rows = docs.join(chosen, "doc_id").select("toxic", "text").mapInArrow(_near_key, "toxic double, text string, near bigint")
    # one of each group of copies, else all the words of a text that is copied often look typical
    rows = keep(rows.groupBy("near").agg(F.min_by("toxic", F.struct(F.xxhash64("text"), "toxic")).alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "toxic")).alias("text")).select("toxic", "text"), "labelled")
    sums = rows.filter("toxic >= 0.5").mapInArrow(_stem_counts, "k bigint, stem bigint, parent bigint, toxic bigint, clean bigint, docs bigint")
    sums = sums.groupBy("k", "stem").agg(F.min("parent").alias("parent"), F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs")).filter(f"k = 0 OR docs >= {MIN_TOXIC_DOCS}").toPandas()
    toxic_words = int(sums.loc[sums.k == 0, "toxic"].sum())
    sums = sums[sums.k > 0]
    wanted = {int(k): np.sort(g.stem.to_numpy(np.int64).view(np.uint64)) for k, g in sums.groupby("k")}
    if not wanted:
        return {}
    shared = spark.sparkContext.broadcast(wanted)
    clean_rows = rows.filter("toxic < 0.5")
    clean = clean_rows.mapInArrow(_clean_counts(shared), "k bigint, stem bigint, clean bigint").groupBy("k", "stem").agg(F.sum("clean").alias("clean")).toPandas()
    clean_words = clean_rows.select(F.sum(F.regexp_count("text", F.lit("[\\p{L}\\p{M}\\p{N}_]+")))).head()[0] or 1
    both = sums.merge(clean, on=["k", "stem"], how="left").fillna({"clean": 0})
    ratio = (both.toxic / max(1, toxic_words)) / ((both.clean + 0.5) / clean_words)
    share = toxic_words / max(1, toxic_words + clean_words)
    total = both.toxic + both.clean
    llr = 2 * (both.toxic * np.log(both.toxic / (total * share)) + both.clean * np.log(np.maximum(both.clean, 1e-9) / (total * (1 - share))))
    both = both[(ratio >= MIN_RATIO) & (llr >= MIN_LLR)]
    names = set(zip(both.k, both.stem))
    both = both[[(k - 1, p) not in names for k, p in zip(both.k, both.parent)]]
    # a beginning that is left out here is within one that is kept, so that this is closed downwards
    return {int(k): np.sort(g.stem.to_numpy(np.int64).view(np.uint64)) for k, g in both.groupby("k")}


def _flag(shared, threshold: float, density: float) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, machine = shared.value
        stretch = int(threshold * 1000 / density) if density > 0 else 1 << 40
        for batch, low, texts in ((b, low, texts) for b in batches for low, _, texts in kernel.chunks(b.column(1))):
            score, clauses, words, densest = score_texts(texts, lexicon, machine, stretch)
            # sums of floats differ in the last places
            bad = np.flatnonzero((densest >= threshold - 1e-9) | (score >= threshold) & (score * 1000 >= density * words))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(bad + low)), pa.array(np.round(score[bad], 6)), pa.array(clauses[bad])], ["doc_id", "score", "n_clauses"])

    return run


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, density: float = DENSITY, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, score, n_clauses) of the rows whose matched clauses add up to `threshold` or more, and
    to `density` or more per thousand words, in some stretch of the text or in all of it; a text of any
    length is found by a passage that would be found alone. score and n_clauses are of the whole text.

    A clause scores 0.85 for a bare insult, 1.25 if a target stands up to 5 words before it, 0.25 more if
    one follows; a threat 0.4, or 2.5 with its target up to 5 words before or after it; a learned stem
    counts 0.75 of an insult. Within
    3 words of a negation nothing counts; up to 12 words after a verb of saying, 0.4 of it.

    Null and empty texts never match. Rows with a null doc_id are scored like others. Repeated rows give
    repeated result rows. Labels that differ for one doc_id are averaged; without labels only the base
    list counts. Texts are scored whole. Empty table: empty result. Other columns are ignored, whatever
    their names.
    """
    spark = docs.sparkSession
    lexicon = Lexicon.base(learn_stems(docs, labels, max_train))
    shared = spark.sparkContext.broadcast((lexicon, grammar()))
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_flag(shared, threshold, density), "doc_id bigint, score double, n_clauses bigint")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
