"""Language identification by prediction by partial matching.

One context tree per language over the bytes of lower-cased text, contexts of zero to three bytes. A symbol costs
``-log P`` under the longest context that has seen it; each shorter context on the way costs an escape (method C: a
context with d distinct followers in t occurrences escapes with probability d / (t + d)). The statistics are frozen
after training, so the code length of a text is a sum over its positions, and the language with the shortest code wins.

Counts cover every training text, and so do the totals and followers of every context; they stay in a stored table. What
goes to the executors is cut by the two bytes in the middle of a gram: its node, the context before it and the three-byte
node it escapes to share them, so a part of the trees prices its own grams alone. A part has at most ``GRAMS`` four-byte
nodes, contexts and three-byte nodes each, or one pair of middle bytes; nodes of one and two bytes are in all. Texts are
read once per part, one part at a time, and what their grams cost is summed over the parts, so every text is judged by the
whole trees and no gram becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispark.llm.textkit import text_chunks
from lexispark.session import settle

GRAMS = 400_000         # bound of a part of the model
SLACK = 2.0             # a text may cost so many times what the training texts of its language cost
SHORT = 8.0             # and so many bits per byte more, over the square root of its length
UNDETERMINED = "und"
_PAD = "\n\n\n"
_HELD = 500_000         # grams that a counting task keeps before it passes them on
_UNIT = 2.0**32         # log probabilities are summed over rows in such parts, so that their order does not matter
_COARSE = 2.0**28       # likewise over the parts of the trees; a text may have gigabytes


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The four-byte gram that ends at each byte of each text, and start and end of the texts among the bytes."""
    parts = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(_PAD.encode() + b"".join(p + _PAD.encode() for p in parts), np.uint8).astype(np.uint32)
    codes = data.copy()
    for back in (1, 2, 3):
        codes[3:] |= data[3 - back:len(data) - back] << np.uint32(8 * back)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = 3 + np.cumsum(lengths + 3) - 3
    return codes, ends - lengths, ends


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat, weight = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    flat, weight = flat[order], weight[order]
    new = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    return flat[new], np.add.reduceat(weight, new)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes: dict[str, list] = {}
    counts: dict[str, list] = {}

    def emit(lang: str) -> pa.RecordBatch:
        found, weight = _summed(codes.pop(lang), counts.pop(lang))
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(found)), pa.array(found.astype(np.int64)), pa.array(weight)], ["lang", "gram", "n"])

    for batch in text_chunks(batches, "text"):
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, name in zip(texts, langs) if name == lang and t]
            if not own:
                continue
            grams, starts, ends = _grams(own)
            inside = np.zeros(len(grams) + 1, np.int8)
            np.add.at(inside, starts, 1)
            np.add.at(inside, ends, -1)
            found, weight = np.unique(grams[np.cumsum(inside[:-1]) > 0], return_counts=True)
            codes.setdefault(lang, []).append(found)
            counts.setdefault(lang, []).append(weight.astype(np.int64))
            if sum(map(len, codes[lang])) > _HELD:
                merged = _summed(codes[lang], counts[lang])
                codes[lang], counts[lang] = [merged[0]], [merged[1]]
                if len(merged[0]) > _HELD // 2:
                    yield emit(lang)
    for lang in sorted(codes):
        yield emit(lang)


class Index:
    """Position of 32-bit keys in a fixed set, -1 if absent, for many keys at once."""

    BITS = 21

    def __init__(self, keys: np.ndarray) -> None:
        place = self._place(keys)
        self.order = np.argsort(place, kind="stable")
        self.keys = np.append(keys[self.order], np.uint32(0))
        self.low = np.searchsorted(place[self.order], np.arange((1 << self.BITS) + 1)).astype(np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(32 - self.BITS)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place = self._place(keys)
        at, end = self.low[place], self.low[place + 1]
        hit = (at < end) & (self.keys[at] == keys)
        found = np.full(len(keys), -1, np.int32)
        order = self.order if len(self.order) else np.zeros(1, np.int64)
        found[hit] = order[at[hit]]
        rest = np.flatnonzero(~hit & (at + 1 < end))
        while len(rest):
            at[rest] += 1
            hit = self.keys[at[rest]] == keys[rest]
            found[rest[hit]] = order[at[rest[hit]]]
            rest = rest[~hit]
            rest = rest[at[rest] + 1 < end[rest]]
        return found


class Model:
    """Frozen context trees of all languages, as tables of natural-log probabilities."""

    def __init__(self, langs: list[str], grams: Sequence[np.ndarray] = (), counts: Sequence[np.ndarray] = (),
                 levels: list[list[tuple]] | None = None) -> None:
        """Per language its four-byte grams (sorted) and their counts, or what :func:`train` has made of them.

        ``levels`` has, per language and order 0 to 3, the nodes with their log probabilities and the contexts with their
        log escapes.
        """
        if levels is None:
            levels = [[self._tree(g.astype(np.int64), n.astype(np.float64), order) for order in range(4)]
                      for g, n in zip(grams, counts)]
        self.langs = langs
        width = len(langs)
        empty = [np.zeros(0, np.int64)]

        def every(order: int, part: int) -> np.ndarray:
            return np.unique(np.concatenate([*[own[order][part] for own in levels], *empty])).astype(np.uint32)

        self.four, self.before = every(3, 0), every(3, 2)
        self.three = np.union1d(every(2, 0), np.unique(self.four & np.uint32(0xFFFFFF))).astype(np.uint32)
        self.log4 = np.zeros((len(self.four), width), np.float32)
        self.log3 = np.zeros((len(self.three), width), np.float32)
        self.escape3 = np.zeros((len(self.before), width), np.float32)
        self.log2 = np.zeros((1 << 16, width), np.float32)
        self.escape2 = np.zeros((1 << 16, width), np.float32)
        for k in range(width):
            self._language(k, levels[k])
        self.find4, self.find3, self.find_before = Index(self.four), Index(self.three), Index(self.before)
        self.left_out: np.ndarray | None = None     # by middle bytes, whether grams are another part's
        self.others: Callable[[], Iterator[Model]] | None = None       # makes the other parts, one after the other
        # what the training texts of each language cost, in bits per byte
        self.own = np.zeros(width)
        for k, (own_grams, own_counts) in enumerate(zip(grams, counts)):
            if len(own_grams):
                self.own[k] = self.spent(k, own_grams, own_counts) / own_counts.sum()

    def __getstate__(self) -> dict:
        return {**self.__dict__, "others": None}    # tables do not travel to the executors

    def spent(self, k: int, grams: np.ndarray, counts: np.ndarray) -> float:
        """Bits that counted grams cost in one language."""
        return float(-(self.log_probability(grams.astype(np.uint32))[:, k].astype(np.float64) @ counts) / np.log(2))

    @staticmethod
    def _tree(grams: np.ndarray, counts: np.ndarray, order: int) -> tuple:
        """Nodes, their log probabilities, contexts, and their log escapes."""
        keys, inverse = np.unique(grams & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        weight = np.bincount(inverse, counts, len(keys))
        contexts, context_of = np.unique(keys >> 8, return_inverse=True)
        total = np.bincount(context_of, weight, len(contexts))
        followers = np.bincount(context_of, minlength=len(contexts)).astype(np.float64)
        return keys, np.log(weight / (total + followers)[context_of]), contexts, np.log(followers / (total + followers))

    def _language(self, k: int, levels: list[tuple]) -> None:
        def put(column: np.ndarray, known: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
            column[np.searchsorted(known, keys.astype(np.int64))] = values

        # order -1 and 0: every byte has a probability
        keys, logs, _, escape = levels[0]
        symbol = np.full(256, escape[0] - np.log(256.0))
        symbol[keys] = logs
        # order 1, dense
        keys, logs, contexts, escape = levels[1]
        away = np.zeros(256)
        away[contexts] = escape
        dense = (away[:, None] + symbol[None, :]).ravel()
        dense[keys] = logs
        self.log2[:, k] = dense
        # order 2 over all three-byte nodes of any language; a node that was left out costs an escape, as an unseen one
        keys, logs, contexts, escape = levels[2]
        self.escape2[contexts, k] = escape
        three = self.three.astype(np.int64)
        self.log3[:, k] = self.escape2[three >> 8, k] + dense[three & 0xFFFF]
        put(self.log3[:, k], three, keys, logs)
        # order 3 over all four-byte nodes of any language
        keys, logs, contexts, escape = levels[3]
        before, four = self.before.astype(np.int64), self.four.astype(np.int64)
        put(self.escape3[:, k], before, contexts, escape)
        context = np.minimum(np.searchsorted(before, four >> 8), max(len(before) - 1, 0))
        if len(four):
            known = before[context] == four >> 8 if len(before) else np.zeros(len(four), bool)
            away = np.where(known, self.escape3[context, k], 0) if len(before) else np.zeros(len(four))
            self.log4[:, k] = away + self.log3[np.searchsorted(three, four & 0xFFFFFF), k]
            put(self.log4[:, k], four, keys, logs)

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each gram after the bytes before it, one column per language."""
        found = self.find4(codes)
        missed = np.flatnonzero(found < 0)
        out = self.log4[np.maximum(found, 0)] if len(self.four) else np.zeros((len(codes), len(self.langs)), np.float32)
        if len(missed):
            rest = codes[missed]
            context = self.find_before(rest >> np.uint32(8))
            value = np.where((context >= 0)[:, None], self.escape3[np.maximum(context, 0)] if len(self.before) else 0, 0)
            three = self.find3(rest & np.uint32(0xFFFFFF))
            lower = self.escape2[(rest >> np.uint32(8)) & np.uint32(0xFFFF)] + self.log2[rest & np.uint32(0xFFFF)]
            if len(self.three):
                lower = np.where((three >= 0)[:, None], self.log3[np.maximum(three, 0)], lower)
            out[missed] = value + lower
        return out

    def lengths(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which texts have a letter; the log probability of this part's grams of them in each language; their bytes."""
        import regex

        chosen = np.flatnonzero(np.array([bool(t) and regex.search(r"\p{L}", t) is not None for t in texts], bool))
        if not len(chosen) or not self.langs:
            return np.zeros(0, np.int64), np.zeros((0, len(self.langs))), np.zeros(0, np.int64)
        codes, starts, ends = _grams([texts[i] for i in chosen])
        if self.left_out is None:
            values = self.log_probability(codes)
        else:
            own = np.flatnonzero(~self.left_out[(codes >> np.uint32(8)) & np.uint32(0xFFFF)])
            values = np.zeros((len(codes), len(self.langs)), np.float32)
            values[own] = self.log_probability(codes[own])
        sums = np.add.reduceat(values, np.column_stack((starts, ends)).ravel(), axis=0, dtype=np.float64)[0::2]
        return chosen, sums, ends - starts

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        """Language, score, and the code length in bits per byte, by a model of one part.

        The score is the language's share of the posterior, halved for every bit per byte that the text costs beyond what
        a text of that language may cost: ``SLACK`` times what its training texts cost, a bit, and an allowance for short
        texts. Text of no learned language costs several times as much in each, so its best share says nothing.
        """
        names, scores, bits = [UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts)
        chosen, sums, size = self.lengths(texts)
        if len(chosen):
            for i, name, s, c in zip(chosen.tolist(), *_verdicts(self.langs, self.own, sums, size)):
                names[i], scores[i], bits[i] = name, s, c
        return names, scores, bits


def _verdicts(langs: list[str], own: np.ndarray, sums: np.ndarray, size: np.ndarray) -> tuple[list[str], list[float], list[float]]:
    """Language, score and bits per byte from the log probabilities and the bytes of texts."""
    best = sums.argmax(axis=1)
    share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    cost = -sums.max(axis=1) / np.log(2) / size
    allowed = SLACK * own[best] + 1 + SHORT / np.sqrt(size)
    share = share * np.exp2(-np.maximum(cost - allowed, 0))
    return [langs[k] for k in best.tolist()], share.tolist(), cost.tolist()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", grams: int = GRAMS) -> Model:
    """Count all texts with a language; null languages and null or empty texts teach nothing.

    Returns the part of the trees that prices most grams; it knows how to make the others, if there are any.
    """
    counted = (
        docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
        .mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    counted = settle(counted)
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())      # as many rows as languages
    if not langs:
        return Model([])
    known, away = zip(*[_level(counted, order) for order in range(4)])
    number = (F.array_position(F.array(*[F.lit(name) for name in langs]), F.col("lang")) - 1).cast("int")

    def together(*levels: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [
            rows.select(F.lit(kind).alias("kind"), number.alias("k"), "gram", "n", "log") for kind, rows in enumerate(levels)])

    def tables(rows: DataFrame, kinds: int) -> list[list[tuple]]:
        """By kind and language, grams and logs of rows whose number is bounded."""
        found = rows.select((F.col("kind") * len(langs) + F.col("k")).alias("of"), "gram", "log").toArrow()
        of, gram, log = [found[c].to_numpy() for c in ("of", "gram", "log")]
        order = np.lexsort((gram, of))
        cuts = np.searchsorted(of[order], np.arange(kinds * len(langs) + 1))
        own = [(gram[order[x:y]], log[order[x:y]]) for x, y in zip(cuts[:-1], cuts[1:])]
        return [own[kind * len(langs):(kind + 1) * len(langs)] for kind in range(kinds)]

    # four-byte nodes, their contexts, three-byte nodes
    middle = F.when(F.col("kind") == 1, F.col("gram")).otherwise(F.shiftright("gram", 8)).bitwiseAND(F.lit(0xFFFF).cast("long"))
    whole = settle(together(known[3], away[3], known[2]).withColumn("pair", middle))
    low = tables(together(known[0], away[0], known[1], away[1], away[2]), 5)        # at most 65,536 a language
    # a text may cost about what the training texts cost
    own_cost = np.zeros(len(langs))
    for r in whole.where("kind = 0").groupBy("k").agg(
            F.sum(F.round(F.col("log") * _UNIT).cast("decimal(38,0)") * F.col("n")).alias("log"), F.sum("n").alias("n")).collect():
        own_cost[r.k] = -float(r.log) / _UNIT / np.log(2) / r.n
    part_of = _dealt(whole, grams)
    parts = int(part_of.max()) + 1
    if parts > 1:
        # one row per pair of bytes
        dealt = docs.sparkSession.createDataFrame(list(enumerate(part_of.tolist())), "pair long, part int")
        whole = settle(whole.join(F.broadcast(dealt), "pair"))

    def part(turn: int) -> Model:
        four, before, three = tables(whole if parts == 1 else whole.where(F.col("part") == turn), 3)
        model = Model(langs, levels=[
            [low[0][k] + low[1][k], low[2][k] + low[3][k], three[k] + low[4][k], four[k] + before[k]] for k in range(len(langs))])
        model.own = own_cost
        model.left_out = part_of != turn if parts > 1 else None
        return model

    first = part(0)
    if parts > 1:
        first.others = lambda: map(part, range(1, parts))
    return first


def _dealt(whole: DataFrame, budget: int) -> np.ndarray:
    """The part of each pair of middle bytes, those of most grams first; pairs without a node are in the first part."""
    sizes = whole.groupBy("pair", "kind", "gram").agg(F.sum("n").alias("n")).groupBy("pair", "kind").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("n")).groupBy("pair").agg(
        F.max("size").alias("size"), F.sum("n").alias("n")).toArrow()       # at most 65,536 rows
    pair, size, n = [sizes[c].to_numpy() for c in ("pair", "size", "n")]
    part_of, part, held = np.zeros(1 << 16, np.int32), 0, 0
    for i in np.lexsort((pair, -n)).tolist():
        if held and held + size[i] > budget:
            part, held = part + 1, 0
        part_of[pair[i]] = part
        held += size[i]
    return part_of


def _level(counted: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """All nodes and contexts of one order, with log probability and log escape."""
    nodes = counted
    if order < 3:
        node = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1).cast("long"))
        nodes = counted.groupBy("lang", node.alias("gram")).agg(F.sum("n").alias("n"))
    nodes = nodes.withColumn("context", F.shiftright("gram", 8))
    contexts = nodes.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("followers"))
    both = F.col("total") + F.col("followers")
    known = nodes.join(contexts, ["lang", "context"]).select("lang", "gram", "n", F.log(F.col("n") / both).alias("log"))
    away = contexts.select(
        "lang", F.col("context").alias("gram"), F.col("total").alias("n"), F.log(F.col("followers") / both).alias("log"))
    return known, away


def _judged(texts: DataFrame, model: Model, limit: int) -> DataFrame:
    """(name, lang_pred, score, bits_per_byte) of all texts (name, text) with a letter, under all parts of the trees."""
    width = len(model.langs)
    langs, own = model.langs, model.own

    def priced(one: Model) -> DataFrame:
        shared = texts.sparkSession.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_chunks(batches, "text", limit):
                chosen, sums, size = shared.value.lengths(batch.column("text").to_pylist())
                parts = np.rint(sums * _COARSE).astype(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(chosen) + 1, dtype=np.int32) * width), pa.array(parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("name").take(pa.array(chosen)), lists, pa.array(size)], ["name", "sums", "size"])

        stored = settle(texts.mapInArrow(run, "name string, sums array<long>, size long").dropDuplicates(["name"]))
        shared.destroy()        # before the next part is made
        return stored

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = batch.column("sums").flatten().to_numpy().reshape(-1, width) / _COARSE
                found = _verdicts(langs, own, sums, batch.column("size").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("name"), pa.array(found[0], pa.string()), *[pa.array(x, pa.float64()) for x in found[1:]]],
                    ["name", "lang_pred", "score", "bits_per_byte"])

    every = reduce(DataFrame.unionByName, list(map(priced, chain([model], model.others()))))
    return every.groupBy("name").agg(
        F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums"), F.max("size").alias("size")).mapInArrow(
        last, "name string, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred, score and bits_per_byte, predicted from the text alone.

    A null text, one without a letter, or any text under a model without languages is ``und`` with score 0 and no code
    length; equal code lengths go to the first language in byte order; columns with these names are replaced.
    """
    added = ("lang_pred", "score", "bits_per_byte")
    base = docs.select(*[c for c in docs.columns if c not in added])
    fields = base.columns
    limit = max(1 << 14, (1 << 20) // max(4, len(model.langs)))
    if model.left_out is not None:
        name = F.sha2(F.col(text), 256)
        # a text is judged by its name, so that rows need not move with their texts where nobody asks for them
        found = settle(_judged(base.select(name.alias("name"), F.col(text).alias("text")).where("text is not null"), model, limit))
        return base.withColumn("__name", name).join(found.withColumnRenamed("name", "__name"), "__name", "left").select(
            *fields, F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"),
            F.coalesce("score", F.lit(0.0)).alias("score"), "bits_per_byte")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text, limit):
            names, scores, bits = shared.value.classify(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in fields], pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(bits, pa.float64())], [*fields, *added])

    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return base.mapInArrow(run, schema)
