"""Brown class-based n-gram scoring.

P(word | words before) = P(class | class before) * P(word | class). Every word
that occurs LEAST times or more has a class of its own, rarer ones that of
their last three bytes. Classes come from exchange clustering. It starts from
the FREQUENT most frequent words and the endings, exchanged one by one on a
bigram table of fixed size. In each of ROUNDS sweeps, Spark counts the classes
on both sides of every word in all training texts; each word moves to the
class that suits its counts best, all at once, and the frequent words and
endings are exchanged anew. The classes under which the class bigrams are most
likely are taken. Nothing grows with the corpus but word counts, the (word,
neighbour class) counts, and a broadcast of 9 bytes per word with a class.

Counts of the words are needed for every token. The HEAD most frequent are a
broadcast of fixed size; all others, of any number, are joined by hash: each
text sends one row per rare word to the word's partition and the sums return
to the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spans_of, text_bytes
from .textbatch import byte_codes, mix, per_text, word_hashes, words

FREQUENT, ENDINGS, CLASSES = 512, 512, 64
LEAST = 5
ROUNDS = 2
HEAD = 1 << 18
SWEEPS = 8
#: neighbours gathered by a task before they are counted
GATHER = 1 << 21
#: word numbers handled at once; a longer text is handled alone
CHUNK_CODES = 1 << 19
#: words, and cells of the table of units, whose counts travel together
PART_WORDS, TABLE_CELLS = 1 << 12, 1 << 17
PRIOR = 10.0


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and ending numbers of all words, A-Z as a-z, and the first word's number per text."""
    starts, ends, first = words(buf, off)
    code = byte_codes(True)
    tail = np.zeros(len(starts), np.uint64)
    for k in range(1, 4):
        has = ends - k >= starts
        tail = tail * np.uint64(0x9E3779B97F4A7C15) + np.where(has, code[buf[np.maximum(ends - k, 0)]], np.uint64(0)) if len(buf) else tail
    return word_hashes(buf, starts, ends, True).view(np.int64), (mix(tail) % np.uint64(ENDINGS)).astype(np.int64), first


def _chunks(batches, column: int):
    for b in batches:
        buf, off = text_bytes(b.column(column))
        for i, j in spans_of(off):
            yield b, i, j, tokens(buf[off[i]:off[j]], off[i:j + 1] - off[i])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, ending, n): every distinct word of the texts by its 64-bit hash."""
    def run(batches):
        for _, _, _, (h, ending, _) in _chunks(batches, 0):
            at, n = np.unique(h, return_index=True, return_counts=True)[1:]
            yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(ending[at]), pa.array(n)], names=["h", "ending", "n"])

    raw = docs.select(text).mapInArrow(run, "h long, ending long, n long")
    return raw.groupBy("h").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words and their counts, HEAD at most: all whose count
    reaches a threshold that a histogram in steps of an eighth power of two
    gives, so that nothing is sorted and little comes to the driver."""
    step = F.floor(F.log2("n") * 8)
    total, least = 0, None
    for at, n in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if total + n > HEAD:
            break
        total, least = total + n, at
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = counts.where(step >= least).select("h", "n").toArrow()
    return top.column("h").to_numpy(), top.column("n").to_numpy()


class Units:
    """Numbers of words. A word's code is its place among the ``frequent`` ones,
    FREQUENT + its ending, or ``end`` + its place among the other ``words`` with
    a class (sorted hashes). Its unit is the code of a frequent word or ending,
    and ``end`` + 1 + class of the others; ``end`` is the end of a text. Without
    ``classes`` the other words have their endings' units."""

    def __init__(self, frequent: np.ndarray, words: np.ndarray, endings: np.ndarray, classes: np.ndarray | None = None):
        self.frequent, self.words, self.endings, self.classes = np.sort(frequent), words, endings.astype(np.int16), classes
        self.end = FREQUENT + ENDINGS
        self.n = self.end + 1 + CLASSES

    def with_classes(self, classes: np.ndarray) -> Units:
        return Units(self.frequent, self.words, self.endings, classes)

    def codes(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        code = FREQUENT + ending
        for known, first in ((self.words, self.end), (self.frequent, 0)):
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                code = np.where(known[at] == h, first + at, code)
        return code

    def of(self, code: np.ndarray) -> np.ndarray:
        own = code >= self.end
        place = np.where(own, code - self.end, 0)
        if not len(self.words):
            return code
        return np.where(own, FREQUENT + self.endings[place] if self.classes is None else self.end + 1 + self.classes[place].astype(np.int64), code)

    def sequence(self, u: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens with an end behind each text, and the token's place of each end."""
        texts = len(first) - 1
        ends = first[1:] + np.arange(texts)
        out = np.full(len(u) + texts, self.end, np.int64)
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner] = u
        return out, ends


def encoded(docs: DataFrame, units: Units, text: str = "text") -> DataFrame:
    """(codes): every text as the codes of its words, written."""
    shared = docs.sparkSession.sparkContext.broadcast(units)

    def run(batches):
        for _, _, _, (h, ending, first) in _chunks(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(
                pa.array(first.astype(np.int32)), pa.array(shared.value.codes(h, ending).astype(np.int32)))], names=["codes"])

    return cut(docs.select(text).mapInArrow(run, "codes array<int>"), "codes")


def _blocks(key: np.ndarray, n: np.ndarray, size: int, name) -> pa.RecordBatch:
    """Sorted keys with their counts as rows of ``size`` keys' room each."""
    part = key // size
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(key) else np.zeros(0, int)
    ends = np.append(cuts[1:], len(key))
    return pa.RecordBatch.from_arrays([
        pa.array([name(int(part[a])) for a in cuts], pa.int64()),
        pa.array([(key[a:b] - part[a] * size).astype(np.int32).tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
        pa.array([n[a:b].astype(np.int64).tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["part", "cell", "n"])


def unit_counts(codes: DataFrame, units: Units, classes: np.ndarray | None = None) -> DataFrame:
    """Counts over all texts as rows (part, cell int32s, n int64s), one per part.

    Parts -1, -2, ... hold the pairs of neighbouring units, before * units +
    unit, an end before each text, TABLE_CELLS cells a part. With ``classes`` of
    the units, part p holds for the words from p * PART_WORDS on how often a
    class stands before (cell = word * 2 CLASSES + class) and behind (+ CLASSES)
    each. A task adds up its own counts first."""
    shared = codes.sparkSession.sparkContext.broadcast((units, classes))

    def neighbours(keys):
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        return _blocks(key, n, PART_WORDS * 2 * CLASSES, lambda p: p)

    def run(batches):
        (u, g), total, keys = shared.value, None, []
        for b in batches:
            flat, off = b.column(0).flatten(), np.append(0, np.cumsum(b.column(0).value_lengths().to_numpy(zero_copy_only=False)))
            for i, j in spans_of(off, CHUNK_CODES):
                code = flat.slice(off[i], off[j] - off[i]).to_numpy(zero_copy_only=False).astype(np.int64)
                seq, ends = u.sequence(u.of(code), off[i:j + 1] - off[i])
                # the token before a text's first is the end of the one above
                n = np.bincount(np.append(u.end, seq[:-1]) * u.n + seq, minlength=u.n * u.n).astype(np.int32)
                total = n.astype(np.int64) if total is None else total + n
                if g is not None:
                    inner = np.ones(len(seq), bool)
                    inner[ends] = False
                    own = code >= u.end
                    at, place = np.flatnonzero(inner)[own], (code[own] - u.end) * (2 * CLASSES)
                    c = g[seq]
                    keys += [place + np.append(g[u.end], c[:-1])[at], place + CLASSES + c[at + 1]]
                    if sum(map(len, keys)) > GATHER:
                        yield neighbours(keys)
                        keys = []
        if keys:
            yield neighbours(keys)
        if total is not None:
            cell = np.flatnonzero(total)
            yield _blocks(cell, total[cell], TABLE_CELLS, lambda p: -1 - p)

    def add(batches):
        part, total = None, None
        for b in batches:
            for p, cell, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if p != part:
                    if part is not None:
                        yield whole(part, total)
                    part, total = p, np.zeros(TABLE_CELLS if p < 0 else PART_WORDS * 2 * CLASSES, np.int64)
                total[np.frombuffer(cell.as_buffer(), np.int32)] += np.frombuffer(n.as_buffer(), np.int64)
        if part is not None:
            yield whole(part, total)

    def whole(part, total):
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                                           pa.array([total[at].tobytes()], pa.binary())], names=["part", "cell", "n"])

    schema = "part long, cell binary, n binary"
    return codes.mapInArrow(run, schema).repartition("part").sortWithinPartitions("part").mapInArrow(add, schema)


def _table(counts: DataFrame, units: Units) -> np.ndarray:
    out = np.zeros(-(-units.n * units.n // TABLE_CELLS) * TABLE_CELLS)
    for part, cell, n in counts.where("part < 0").collect():
        out[(-1 - part) * TABLE_CELLS + np.frombuffer(cell, np.int32)] = np.frombuffer(n, np.int64)
    return out[:units.n * units.n].reshape(units.n, units.n)


def best_classes(counts: DataFrame, old: np.ndarray, both: np.ndarray) -> np.ndarray:
    """The class of every word that suits its neighbours' classes best under
    the class bigrams ``both``, less the word's own share in its old class."""
    shared = counts.sparkSession.sparkContext.broadcast((old, both))

    def run(batches):
        g, n = shared.value
        out, into = n.sum(1), n.sum(0)
        fit = np.log(n + 0.5) - np.log(out + 0.5)[:, None] - np.log(into + 0.5)
        for b in batches:
            for p, cell, many in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                near = np.zeros((PART_WORDS, 2 * CLASSES))
                near.reshape(-1)[np.frombuffer(cell.as_buffer(), np.int32)] = np.frombuffer(many.as_buffer(), np.int64)
                real = np.flatnonzero(near.any(1))
                word, near = p * PART_WORDS + real, near[real]
                c, r = near[:, :CLASSES], near[:, CLASSES:]
                was, size = g[word].astype(np.int64), r.sum(1)
                gain = r @ fit.T + c @ fit
                less = lambda a, x: np.log(np.maximum(a - x, 0) + 0.5)
                gain[np.arange(len(word)), was] = (
                    (r * (less(n[was], r) - np.log(into + 0.5))).sum(1) + (c * (less(n.T[was], c) - np.log(out + 0.5))).sum(1)
                    - size * (less(out[was], size) + less(into[was], size)))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(gain.argmax(1).astype(np.int16))], names=["word", "class"])

    got = counts.where("part >= 0").mapInArrow(run, "word long, class short").toArrow()
    new = old.copy()
    new[got.column("word").to_numpy()] = got.column("class").to_numpy()
    return new


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS, start: np.ndarray | None = None,
             fixed: int = 0) -> np.ndarray:
    """Exchange clustering: the class of every unit.

    ``bigrams[v, w]`` counts unit w behind v. Starting from ``start``, or from
    units dealt out by frequency, each unit but the last ``fixed`` in turn moves
    to the class that gives the corpus the highest class bigram likelihood,
    until a sweep moves nothing."""
    n = bigrams.astype(float)
    size = n.sum(0)
    order = np.argsort(-size, kind="stable")
    g = np.empty(len(n), np.int64)
    g[order] = np.arange(len(n)) % classes
    if start is not None:
        g = start.copy()
    order = order[order < len(n) - fixed]
    hot = np.eye(classes)[g]
    right, left = n @ hot, (n.T @ hot)  # by the neighbour's class
    both = hot.T @ right
    mass_l, mass_r = both.sum(1), both.sum(0)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not size[w] and not right[w].sum():
                continue
            old, self_ = g[w], n[w, w]
            r, c = right[w].copy(), left[w].copy()
            r[old] -= self_
            c[old] -= self_
            both[old] -= r
            both[:, old] -= c
            both[old, old] -= self_
            out_w, in_w = r.sum() + self_, c.sum() + self_
            mass_l[old] -= out_w
            mass_r[old] -= in_w
            gain = (_f(both + r) - _f(both)).sum(1) + (_f(both.T + c) - _f(both.T)).sum(1)
            d = np.diag(both)
            gain += _f(d + r + c + self_) - _f(d + r) - _f(d + c) + _f(d)
            gain -= _f(mass_l + out_w) - _f(mass_l) + _f(mass_r + in_w) - _f(mass_r)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            both[new] += r
            both[:, new] += c
            both[new, new] += self_
            mass_l[new] += out_w
            mass_r[new] += in_w
            if new != old:
                moved += 1
                g[w] = new
                right[:, old] -= n[:, w]
                right[:, new] += n[:, w]
                left[:, old] -= n[w]
                left[:, new] += n[w]
        if not moved:
            break
    return g


def likelihood(both: np.ndarray) -> float:
    return float(_f(both).sum() - _f(both.sum(0)).sum() - _f(both.sum(1)).sum())


def clusters(codes: DataFrame, units: Units) -> tuple[Units, np.ndarray, np.ndarray]:
    """The units, their classes and bigrams under the likeliest classes found;
    ``units`` have no classes of the other words yet."""
    seed, words = units, units.words
    g = exchange(_table(unit_counts(codes, seed), seed), fixed=CLASSES)
    g[seed.end + 1:] = np.arange(CLASSES)
    # every second word is dealt out by its hash, so that words of one ending can part
    deal = mix(words.view(np.uint64))
    start = np.where(deal >> np.uint64(63), (deal % np.uint64(CLASSES)).astype(np.int64), g[FREQUENT + units.endings.astype(np.int64)])
    units, best = seed.with_classes(start.astype(np.uint8)), None
    for k in range(ROUNDS + 1 if len(words) else 1):
        more = k < ROUNDS and len(words) > 0
        counts = cut(unit_counts(codes, units, g if more else None), f"class-counts-{k}")
        bigrams = _table(counts, units)
        hot = np.eye(CLASSES)[g]
        both = hot.T @ bigrams @ hot
        if best is None or likelihood(both) > best[0]:
            best = likelihood(both), units, g, bigrams
        if more:
            units = units.with_classes(best_classes(counts, units.classes, both))
            g = exchange(bigrams, start=g, fixed=CLASSES)
    return best[1:]


class Model:
    """log10 tables: class transitions, what a class divides by, the head's counts."""

    def __init__(self, units: Units, classes: np.ndarray, bigrams: np.ndarray, kinds: np.ndarray, head: np.ndarray,
                 head_n: np.ndarray, texts: int):
        self.units, self.classes, self.texts = units, classes, texts
        k = CLASSES
        hot = np.eye(k)[classes]
        n = hot.T @ bigrams @ hot
        prior = (n.sum(0) + 1) / (n.sum() + k)
        self.step = np.log10((n + PRIOR * prior) / (n.sum(1, keepdims=True) + PRIOR))
        self.share = np.log10(hot.T @ bigrams.sum(0) + 0.5 * (hot.T @ kinds + 1))
        order = np.argsort(head)
        self.head, self.head_log = head[order], np.log10(head_n[order] + 0.5)


def train_mask(key: str, folds: int, held: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds)) != held


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score).

    ``train`` tells the rows to learn from, the others are held out.
    ``base_score`` is the unigram add-half log10 probability, ``score`` that of
    the class model. Every row has a result: null, empty and blank texts are
    the end alone. Rows that share a key, repeated rows and null keys are
    scored one by one; extra columns are not read. Without a training row all
    counts are zero. Words are told apart by 64-bit hashes of any length of
    word."""
    spark = docs.sparkSession
    learn = docs.where(train).select(text)
    texts = learn.count()
    counts = cut(word_counts(learn, text), "word-counts")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    n_train, vocabulary = (total or 0) + texts, distinct + (texts > 0)
    head, head_n = frequent_words(counts)
    frequent = head[np.lexsort((head, -head_n))][:FREQUENT]
    often = spark.createDataFrame([(int(h),) for h in frequent], "h long")
    others = counts.join(F.broadcast(often), "h", "left_anti")
    own = others.where(F.col("n") >= LEAST).select("h", F.col("ending").cast("short").alias("ending")).toArrow()
    own_h, own_ending = own.column("h").to_numpy(), own.column("ending").to_numpy()
    order = np.argsort(own_h)
    plain = Units(frequent, own_h[order], own_ending[order])
    units, classes, bigrams = clusters(encoded(learn, plain, text), plain)
    # distinct words per unit: one per frequent word, the others by class or ending
    kinds = np.zeros(units.n)
    kinds[:len(units.frequent)] = 1
    for ending, n in others.where(F.col("n") < LEAST).groupBy("ending").count().collect():
        kinds[FREQUENT + ending] = n
    kinds[units.end] = texts > 0
    kinds[units.end + 1:] = np.bincount(units.classes, minlength=CLASSES)
    model = spark.sparkContext.broadcast(Model(units, classes, bigrams, kinds, head, head_n, texts))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        m, row = model.value, TaskContext.get().partitionId() << 33
        for b, i, j, (h, ending, first) in _chunks(batches, 2):
            seq, ends = m.units.sequence(m.units.of(m.units.codes(h, ending)), first)
            c = m.classes[seq]
            begin = np.append(0, ends + 1)
            lm = per_text(m.step[np.append(m.classes[m.units.end], c[:-1]), c] - m.share[c], begin)
            at = np.minimum(np.searchsorted(m.head, h), max(len(m.head) - 1, 0))
            known = m.head[at] == h if len(m.head) else np.zeros(len(h), bool)
            logs = per_text(np.where(known, m.head_log[at] if len(m.head) else 0.0, 0.0), first) + np.log10(m.texts + 0.5)
            rows = row + np.arange(j - i)
            row += j - i
            rare = np.flatnonzero(~known)
            doc = np.repeat(np.arange(j - i), np.diff(first))[rare]
            # a text's own row goes to a partition by its number, not by a word
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(mix(rows.astype(np.uint64)).view(np.int64)), pa.array(np.zeros(j - i, np.int32)), b.column(0).slice(i, j - i),
                 b.column(1).slice(i, j - i), pa.array(np.diff(begin)), pa.array(per_text(known, first) + int(m.texts > 0)), pa.array(logs), pa.array(lm)], names=names)
            if len(rare):
                order = np.lexsort((h[rare], doc))
                d, w = doc[order], h[rare][order]
                new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])))
                times = np.diff(np.append(new, len(d))).astype(np.int32)
                void = pa.nulls(len(new))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[d[new]]), pa.array(w[new]), pa.array(times), void.cast(b.schema.field(0).type), void.cast(pa.bool_()),
                     void.cast(pa.int64()), void.cast(pa.int64()), void.cast(pa.float64()), void.cast(pa.float64())], names=names)

    names = ["row", "h", "times", key, "held_out", "n_tokens", "n_known", "logs", "lm"]
    sent = docs.select(key, (~train).alias("held_out"), text).mapInArrow(
        run, f"row long, h long, times int, `{key}` {kind}, held_out boolean, n_tokens long, n_known long, logs double, lm double")
    found = sent.join(counts.select("h", "n"), "h", "left")
    rare = F.when(F.col("times") > 0, F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5))
    hit = F.when((F.col("times") > 0) & F.col("n").isNotNull(), F.col("times"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = found.groupBy("row").agg(
        F.max(key).alias(key), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + zero(F.sum(hit))).cast("long").alias("n_known"),
        (F.max("logs") + zero(F.sum(rare))).alias("logs"), F.max("lm").alias("lm"))
    whole = float(np.log10(n_train + 0.5 * (vocabulary + 1)))
    return sums.select(key, "held_out", "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"),
                       (F.col("logs") - F.col("n_tokens") * whole).alias("base_score"), (F.col("logs") + F.col("lm")).alias("score"))
