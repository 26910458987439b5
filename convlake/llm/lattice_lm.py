"""Op 3. Language-model scoring by the marginal likelihood of a subword lattice.

The pieces are those of an existing subword vocabulary. Their ranks there give the first scores, which
expectation-maximisation over the lattices of the training words fits to the corpus until their
likelihood hardly rises; the vocabulary itself is never changed. A word, with its boundary mark, is a
lattice of all its segmentations into pieces (a character that is no piece itself is spelled in bytes),
and a forward recursion in log space sums them. A text is its words and one end, so its probability is
the product of theirs.

Word counts cover the whole corpus and stay in a table. The lattices of the words are laid out once, many
words to a row, and every round runs over them place by place, for all words of a row at a time. Only
scores by piece (as many as the vocabulary has) and the commonest words (``HOT_WORDS`` at most) reach the
driver; every other word of a document is joined with the table by word.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, small_batches, staged, work_dir

#: Rounds of fitting at most, and the gain in log likelihood for each word below which they end.
ROUNDS = 12
TOLERANCE = 0.005
PRIOR = 0.1
HOT_WORDS = 150_000
#: Different words that a task counts before it passes the counts on.
FLUSH = 300_000
END = "</s>"
#: Words and arcs that one row of lattices holds; words of more characters than LONG are walked one by one.
CHUNK_WORDS = 2048
CHUNK_ARCS = 100_000
LONG = 64
#: Rows of lattices that a Python worker holds at once, and bytes of them in a row group.
CHUNKS = 4
ROW_GROUP = 8 << 20
LATTICES = "words array<binary>, c array<long>, n array<long>, sizes binary, arcs binary, spans binary, ids binary"


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, int], list[int], int]:
    """Id by piece, ids of the 256 bytes, and the id of the end.

    Pieces with a letter A-Z can't occur in normalised text and are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = {f"<0x{b:02X}>": b for b in range(256)}
    pieces, in_bytes = {}, [0] * 256
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if piece in spelled:
            in_bytes[spelled[piece]] = k
        elif not (model.is_control(k) or model.is_unknown(k) or any("A" <= c <= "Z" for c in piece)):
            pieces[piece] = k
    return pieces, in_bytes, model.piece_to_id(END)


def first_scores(path: str):
    """Log probabilities by id from the ranks of the vocabulary: the n-th piece weighs 1 / n."""
    import numpy as np

    pieces, in_bytes, end = vocabulary(path)
    known = sorted({*pieces.values(), *in_bytes, end})
    scores = np.full(known[-1] + 1, -np.inf)
    scores[known] = -np.log(np.arange(1, len(known) + 1))
    return scores - math.log(np.exp(scores[known]).sum())


class Arcs:
    """Pieces that end at each place of a word: how long they are, and their ids.

    What ends within the beginning that a word shares with the one before it is kept, so words are best
    given in order. A character that is no piece has the id ``size`` plus its code point.
    """

    def __init__(self, path: str):
        pieces, in_bytes, end = vocabulary(path)
        self.size = max(*pieces.values(), *in_bytes, end) + 1
        #: a piece, or (-1) just the end of one
        self.tails = dict.fromkeys((p[n:] for p in pieces for n in range(len(p))), -1)
        self.tails.update(pieces)
        self.text, self.spans, self.ids = "", [[]], [[]]

    def walk(self, word: str) -> int:
        """Set ``spans`` and ``ids`` for ``word``; the number of places that were kept."""
        text, last, tails = "▁" + word, self.text, self.tails
        same, most = 0, min(len(text), len(last))
        while same < most and text[same] == last[same]:
            same += 1
        del self.spans[same + 1 :], self.ids[same + 1 :]
        for j in range(same + 1, len(text) + 1):
            spans, ids = [], []
            for i in range(j - 1, -1, -1):
                k = tails.get(text[i:j])
                if k is None:
                    break
                if k >= 0:
                    spans.append(j - i)
                    ids.append(k)
            if not spans or spans[0] != 1:
                spans.append(1)
                ids.append(self.size + ord(text[j - 1]))
            self.spans.append(spans)
            self.ids.append(ids)
        self.text = text
        return same


class Lattice:
    """Segmentations of words, weighted by ``scores`` (log probabilities by id)."""

    def __init__(self, path: str, scores):
        pieces, self.in_bytes, self.end = vocabulary(path)
        self.scores = scores.tolist()
        self.pieces = {p: (k, self.scores[k]) for p, k in pieces.items()}
        self.arcs = Arcs(path)
        self.spelled: dict[str, tuple[tuple[int, ...], float]] = {}
        #: log probabilities up to each place of the last word
        self.alpha = [0.0]

    def spell(self, char: str) -> tuple[tuple[int, ...], float]:
        """Ids of the bytes of ``char``, and their score."""
        if char not in self.spelled:
            ids = tuple(self.in_bytes[b] for b in char.encode())
            self.spelled[char] = ids, sum(self.scores[k] for k in ids)
        return self.spelled[char]

    def score(self, k: int) -> float:
        return self.scores[k] if k < self.arcs.size else self.spell(chr(k - self.arcs.size))[1]

    def forward(self, word: str) -> float:
        """Log of the summed probability of all segmentations of ``word``."""
        same, alpha = self.arcs.walk(word), self.alpha
        del alpha[same + 1 :]
        for j in range(same + 1, len(self.arcs.ids)):
            alpha.append(log_sum([alpha[j - n] + self.score(k) for n, k in zip(self.arcs.spans[j], self.arcs.ids[j], strict=True)]))
        return alpha[-1]

    def expect(self, word: str, weight: float, counts) -> None:
        """Add to ``counts`` how often each id is expected in ``weight`` times ``word``.

        From the end backwards, each place passes what reaches it to the places where its pieces start.
        """
        self.forward(word)
        alpha, reach = self.alpha, [0.0] * len(self.alpha)
        reach[-1] = weight
        for j in range(len(alpha) - 1, 0, -1):
            for n, k in zip(self.arcs.spans[j], self.arcs.ids[j], strict=True):
                share = reach[j] * math.exp(alpha[j - n] + self.score(k) - alpha[j])
                reach[j - n] += share
                for one in (k,) if k < self.arcs.size else self.spell(chr(k - self.arcs.size))[0]:
                    counts[one] += share


class Lattices:
    """The lattices of one row: places are numbered by how far into their word they lie, then by word.

    Words come longest first, so those that have a place ``j`` are the first of them.
    """

    def __init__(self, row, lattice: Lattice):
        import numpy as np

        self.lattice = lattice
        self.sizes = np.frombuffer(row.sizes, "<i4")
        width = int(self.sizes.max(initial=0))
        at = np.cumsum(np.bincount(self.sizes, minlength=width + 1)[::-1])[::-1]  # words that have a place j
        self.base = np.concatenate(([0], np.cumsum(at)))
        place = np.repeat(np.arange(width + 1), at)
        word = np.arange(len(place)) - self.base[place]
        arcs, spans = np.frombuffer(row.arcs, "<u2"), np.frombuffer(row.spans, "<u2").astype("int64")
        self.ids = np.frombuffer(row.ids, "<i4")
        self.to = np.repeat(np.arange(len(self.sizes), len(place)), arcs)
        self.start = self.base[place[self.to] - spans] + word[self.to]
        self.first = np.concatenate(([0], np.cumsum(arcs, dtype="int64")))  # first arc of each place behind the starts
        self.last = self.base[self.sizes] + np.arange(len(self.sizes))
        known = self.ids < lattice.arcs.size
        self.chars = np.unique(self.ids[~known])
        extra = np.array([lattice.score(int(k)) for k in self.chars])
        self.score = np.empty(len(self.ids))
        self.score[known] = np.asarray(lattice.scores)[self.ids[known]]
        self.score[~known] = extra[np.searchsorted(self.chars, self.ids[~known])] if len(extra) else 0.0

    def levels(self):
        """By place: its first number, the one behind it, its first arc, the one behind them."""
        n = len(self.sizes)
        for a, b in zip(self.base[1:-1].tolist(), self.base[2:].tolist(), strict=True):
            yield a, b, int(self.first[a - n]), int(self.first[b - n])

    def forward(self):
        """Log of the summed probability of all segmentations of each word."""
        import numpy as np

        self.alpha = alpha = np.zeros(self.base[-1])
        n = len(self.sizes)
        for a, b, f, g in self.levels():
            terms = alpha[self.start[f:g]] + self.score[f:g]
            cut = self.first[a - n : b - n] - f
            most = np.maximum.reduceat(terms, cut)
            alpha[a:b] = most + np.log(np.add.reduceat(np.exp(terms - most[self.to[f:g] - a]), cut))
        return alpha[self.last]

    def expect(self, weights, counts) -> float:
        """Add to ``counts`` how often each id is expected; the log likelihood of the words."""
        import numpy as np

        likely = float(weights @ self.forward())
        reach = np.zeros(len(self.alpha))
        reach[self.last] = weights
        share = np.exp(self.alpha[self.start] + self.score - self.alpha[self.to])
        for _, _, f, g in reversed(list(self.levels())):
            share[f:g] *= reach[self.to[f:g]]
            reach[self.start[f:g]] += share[f:g]  # a word has no two arcs with one start and one end
        known = self.ids < self.lattice.arcs.size
        counts += np.bincount(self.ids[known], share[known], len(counts))
        if len(self.chars):
            for k, total in zip(self.chars, np.bincount(np.searchsorted(self.chars, self.ids[~known]), share[~known]), strict=True):
                for one in self.lattice.spell(chr(k - self.lattice.arcs.size))[0]:
                    counts[one] += total
        return likely


def log_sum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    most = max(terms)
    return most + math.log(sum([math.exp(t - most) for t in terms]))


def count_words(docs: DataFrame) -> DataFrame:
    """word (bytes), c (in rows with ``train``), n (in all rows) of every word of ``docs``."""

    def counts(batches):
        import pandas as pd

        both = (Counter(), Counter())

        def rows():
            words = list(both[0].keys() | both[1].keys())
            out = pd.DataFrame({"word": words, "c": [both[1][w] for w in words], "n": [both[0][w] + both[1][w] for w in words]})
            both[0].clear(), both[1].clear()
            return out

        for pdf in batches:
            for text, train in zip(pdf["text"], pdf["train"], strict=True):
                if text:
                    both[bool(train)].update(text.encode().lower().split())
                    if len(both[0]) + len(both[1]) > FLUSH:
                        yield rows()
        yield rows()

    found = docs.select("text", "train").mapInPandas(counts, "word binary, c long, n long")
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def lattices(words: DataFrame, path: str) -> DataFrame:
    """``words`` with their lattices, many to a row of LATTICES; words longer than LONG have theirs left out."""

    def lay_out(batches):
        import numpy as np
        import pandas as pd

        walker = Arcs(path)
        short, far = [], []
        arcs: list[int] = []
        spans: list[int] = []
        ids: list[int] = []

        def rows():
            sizes = np.array([w[3] for w in short], dtype="int64")
            order = np.argsort(-sizes, kind="stable")
            rank = np.empty(len(order), "int64")
            rank[order] = np.arange(len(order))
            word = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            many = np.array(arcs, dtype="int64")
            by_place = np.lexsort((rank[word], place))
            moved = np.empty(len(by_place), "int64")
            moved[by_place] = np.arange(len(by_place))
            arc = np.argsort(np.repeat(moved, many), kind="stable")
            data = sizes[order].astype("<i4"), many[by_place].astype("<u2"), np.array(spans, "<u2")[arc], np.array(ids, "<i4")[arc]
            out = [([short[k][x] for k in order] for x in range(3))]
            yield pd.DataFrame([[*out[0], *(d.tobytes() for d in data)]], columns=["words", "c", "n", "sizes", "arcs", "spans", "ids"])
            for kept in (short, arcs, spans, ids):
                kept.clear()

        for pdf in batches:
            for row in zip(pdf["word"], pdf["c"], pdf["n"], strict=True):
                word = bytes(row[0]).decode()
                if len(word) > LONG:
                    far.append(row)
                    continue
                walker.walk(word)
                short.append((*row, len(word) + 1))
                arcs.extend(map(len, walker.ids[1:]))
                for n, k in zip(walker.spans, walker.ids, strict=True):
                    spans += n
                    ids += k
                if len(short) >= CHUNK_WORDS or len(ids) >= CHUNK_ARCS:
                    yield from rows()
            if far:
                yield pd.DataFrame([[*([w[x] for w in far] for x in range(3)), None, None, None, None]], columns=["words", "c", "n", "sizes", "arcs", "spans", "ids"])
                far.clear()
        if short:
            yield from rows()

    return words.select("word", "c", "n").sortWithinPartitions("word").mapInPandas(lay_out, LATTICES)


def fit(words: DataFrame, ends: int, path: str, rounds: int = ROUNDS, prior: float = PRIOR):
    """Scores by id, fitted to all counted words (word, c, n)."""
    return fit_lattices(lattices(words, path), ends, path, rounds, prior)[0]


def fit_lattices(laid: DataFrame, ends: int, path: str, rounds: int = ROUNDS, prior: float = PRIOR):
    """Scores by id after at most ``rounds`` of expectation-maximisation, and the log likelihood before each.

    Rounds end early once a word gains less than TOLERANCE.
    """
    import numpy as np

    spark, scores = laid.sparkSession, first_scores(path)
    known = np.isfinite(scores)
    end = vocabulary(path)[2]
    likely: list[float] = []
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(scores)

        def expected(batches, shared=shared):
            import numpy as np
            import pandas as pd

            lattice, counts, total, weight = Lattice(path, shared.value), np.zeros(len(shared.value)), 0.0, 0
            for pdf in batches:
                for row in pdf.itertuples():
                    weight += int(np.sum(row.c))
                    if row.sizes is not None:
                        total += Lattices(row, lattice).expect(np.asarray(row.c, "float64"), counts)
                    else:
                        for word, c in zip(row.words, row.c, strict=True):
                            if c:
                                lattice.expect(bytes(word).decode(), c, counts)
                                total += c * lattice.alpha[-1]
            ids = np.flatnonzero(counts)
            yield pd.DataFrame({"id": [-2, -1, *ids], "expected": [weight, total, *counts[ids]]})

        far = F.when(F.col("sizes").isNull(), F.col("words")).alias("words")  # only they are read as text
        sums = laid.select(far, "c", "sizes", "arcs", "spans", "ids").mapInPandas(expected, "id int, expected double").groupBy("id").agg(F.sum("expected").alias("expected"))
        counts, total, weight = np.zeros(len(scores)), 0.0, 0.0
        with small_batches(spark, CHUNKS):
            found = sums.collect()  # one row per piece of the vocabulary
        shared.destroy()
        for row in found:
            if row["id"] >= 0:
                counts[row["id"]] = row["expected"]
            elif row["id"] == -1:
                total = row["expected"]
            else:
                weight = row["expected"]
        counts[end] = ends
        counts += prior
        scores = np.where(known, np.log(counts), -np.inf) - math.log(counts[known].sum())
        likely.append(total)
        if len(likely) > 1 and total - likely[-2] < TOLERANCE * weight:
            break
    return scores, likely


def score_texts(docs: DataFrame, path: str, rounds: int = ROUNDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Rows whose id has remainder 1 by 5 are held out of all learning. Null texts are empty: their only
    token is the end. A repeated row is scored as often as it comes. With nothing to learn from, the base
    gives every token probability 1 and the model has the scores that the vocabulary came with. Scores
    are log10 probabilities; ``base_score`` is the smoothed unigram model of whole words.
    """
    import numpy as np

    spark, folder = docs.sparkSession, work_dir(docs.sparkSession)
    held = remainder(F.col("doc_id"), 5) == 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held).alias("train"))
    words = staged(count_words(docs), f"{folder}/words")
    ends = docs.where("train").count()
    sums = words.agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    tokens, types = (sums["c"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    laid = staged(lattices(words, path), f"{folder}/lattices", row_group=ROW_GROUP)
    scores = fit_lattices(laid, ends, path, rounds)[0] if ends else first_scores(path)
    shared = spark.sparkContext.broadcast(scores)
    below = math.log10(tokens + 0.5 * (types + 1))

    def weigh(batches):
        import pandas as pd

        lattice = Lattice(path, shared.value)
        for pdf in batches:
            for row in pdf.itertuples():
                found = Lattices(row, lattice).forward() if row.sizes is not None else np.array([lattice.forward(bytes(w).decode()) for w in row.words])
                c = np.asarray(row.c)
                yield pd.DataFrame({"word": list(row.words), "c": c, "n": np.asarray(row.n), "base": np.log10(c + 0.5) - below, "score": found / math.log(10)})

    words = staged(laid.mapInPandas(weigh, "word binary, c long, n long, base double, score double"), f"{folder}/scored", CHUNKS)

    grade = F.floor(F.log2("n") * 8)
    room, least = hot_words, None
    for row in sorted(words.groupBy(grade.alias("grade")).count().collect(), reverse=True):  # a few hundred rows
        room -= row["count"]
        if room < 0:
            break
        least = row["grade"]
    hot = words.where(grade >= least).collect() if least is not None else []  # hot_words at most
    by_word = {bytes(r["word"]): k for k, r in enumerate(hot)}
    table = np.array([(r["base"], r["score"], r["c"] > 0) for r in hot], dtype="float64").reshape(-1, 3)
    hot, end = spark.sparkContext.broadcast((by_word, table)), vocabulary(path)[2]
    end_row = (math.log10(ends + 0.5) - below, scores[end] / math.log(10), int(ends > 0))

    def look(batches):
        import numpy as np
        import pandas as pd

        by_word, table = hot.value
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                words = text.encode().lower().split() if text else []
                at = np.array([by_word.get(w, -1) for w in words], dtype="int64")
                rare = Counter([words[k] for k in np.flatnonzero(at < 0)])
                base, score, known = table[at[at >= 0]].sum(axis=0)
                rows.append((len(words) + 1, end_row[2] + int(known), end_row[0] + base, end_row[1] + score, list(rare), list(rare.values())))
            out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base", "score", "rare", "times"])
            out.insert(0, "held_out", ~pdf["train"].to_numpy(bool))
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out

    partial = docs.mapInPandas(look, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<binary>, times array<int>")
    partial = staged(partial.withColumn("rid", F.monotonically_increasing_id()), f"{folder}/partial")
    rare = partial.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("rid", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    rest = rare.join(words.select("word", "c", "base", "score"), "word").groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_"), F.sum(F.col("times") * F.col("base")).alias("base_"), F.sum(F.col("times") * F.col("score")).alias("score_")
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return partial.drop("rare", "times").join(rest, "rid", "left").select("doc_id", "held_out", "n_tokens", plus("n_known", "known_").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), plus("base", "base_").alias("base_score"), plus("score", "score_").alias("score"))


def op3_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    import public_tokenizers

    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
