"""Splitting oversized texts at natural boundaries (problem 8)."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.llm.tokens import VOCABULARY, encode, token_bytes

#: Kinds of boundary from the best to the worst, and what a cut there costs.
KINDS = ["titulo", "parrafo", "linea", "oracion", "palabra", "token"]
COSTS = np.array([1.0, 2.0, 4.0, 6.0, 12.0, 40.0])  # _candidates relies on how far the last lies above the others
FINAL = "fin"
#: Weight of a piece's squared departure from the even size, in limits.
IMBALANCE = 8.0
#: Texts are worked on together up to this many bytes, and their pieces weighed up to this many at once.
BYTES_AT_ONCE = 1_000_000
WAYS_AT_ONCE = 100_000
#: Pieces of a batch that goes back to Spark, about.
PIECES_AT_ONCE = 20_000
_FAR = 2**30
#: A limit must exceed its overlap by this many tokens, for no character takes more of them than four.
LEAST_STEP = 8


@dataclass(frozen=True)
class Limit:
    tokens: int
    overlap: int

    def __post_init__(self):
        if self.overlap < 0 or self.tokens - self.overlap < LEAST_STEP:
            raise ValueError(f"a limit must exceed its overlap by {LEAST_STEP} tokens, and the overlap can't be negative")


class _Texts:
    """Tokenized texts, one after the other, with the kind of each token boundary."""

    def __init__(self, texts: list[bytes], ids: list[np.ndarray], vocabulary: str):
        self.data = np.frombuffer(b"\0\0\0\0" + b"".join(texts) + b"\0\0\0\0", "uint8")
        self.n = np.array([len(x) for x in ids], "int64")
        self.first = np.r_[0, np.cumsum(self.n)]
        width = token_bytes(vocabulary)[np.concatenate(ids)]
        #: Byte at which each token begins, counted over all texts.
        self.at = np.r_[0, np.cumsum(width, dtype="int64")]
        before = self.data.take
        here = self.at[:-1] + 4
        cur, p1, p2, p3 = (before(here - k) for k in range(4))
        end = _is(b"\r\n")
        blank = _is(b" \t\r\n\v\f")
        stop = _is(b".!?")
        inside = (p1 == 13) & (cur == 10)  # of one line end
        line = end[p1] & ~inside
        kind = np.full(len(cur), 5, "int8")
        kind[blank[cur] | blank[p1]] = 4
        kind[(blank[cur] & stop[p1]) | (blank[p1] & stop[p2] & ~line)] = 3
        kind[line] = 2
        kind[line & ((p1 == 10) & (p2 == 10) | (p1 == 13) & (p2 == 13) | (p1 == 10) & (p2 == 13) & end[p3])] = 1
        kind[line & (cur == 35)] = 0
        kind[inside] = 5
        self.kind = kind
        #: Whether a character begins here; the text could not be cut elsewhere.
        self.whole = (cur & 0xC0) != 0x80
        #: Tokens before each that begin within a character, and the last token up to each that does not.
        self.broken = np.zeros(len(cur) + 1, "int32")
        np.cumsum(~self.whole, out=self.broken[1:])
        self.begin_of = np.maximum.accumulate(np.where(self.whole, np.arange(len(cur), dtype="int32"), 0))
        #: Text of each token, and its place there.
        self.text = np.repeat(np.arange(len(ids), dtype="int32"), self.n)
        self.local = np.arange(len(cur), dtype="int32") - self.first[:-1].astype("int32")[self.text]


def _is(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


def _candidates(t: _Texts, limit: Limit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and boundary (token of the whole list) where an optimal plan may cut the texts over the limit, and what a piece beside it holds at least.

    All boundaries between characters but those inside a word (what lies between two
    natural boundaries, text ends among them) that no optimal plan has:

    A word that fits a piece: cuts before and after the word (l, r) cost less than one
    inside it (i). They make a piece of size t, and those beside it shorter by c and d; in
    limits c + d <= t <= 1, the two have at least c and d, and e <= 1 is the even size. The
    departures grow by no more than (t - e)^2 + 2 e (c + d) - c^2 - d^2 <= t^2 / 2 + e^2
    <= 3 / 2, times IMBALANCE, which is less than a token's price over two of a space. Where
    one of the two cuts or both are there or passed already, leaving out i gains more.

    A longer word of R tokens needs M = ceil(R / U) - 1 cuts, of U = limit - overlap tokens at
    most, and has no more. Say it had M + q, and the pieces beside them reached out by a and
    b of U on both sides. Cuts at l and r with M even ones between them save q token prices
    and cost two of a space at most; with sizes less the overlap, in U, the departures grow by
    (2 - q) e^2 + a^2 + b^2 + R^2 / (M + 1) - (a + b + R)^2 / (M + 1 + q) at most. For q = 1
    this is below 2 (by 4 / U and more where a and b aren't 0, so that rounding the even cuts to
    tokens takes nothing away in words of fewer than 16 limits of cuts, and else the price is
    less), for q > 1 below 2 + q: times IMBALANCE less than what is saved. So the k-th cut lies
    within k U of l and within (M + 1 - k) U of r.

    And the M + 1 pieces beside the M cuts differ by a token at most in all, or moving the
    cuts between a longer and a shorter one by a token would even the two. M pieces in their
    place would spare a cut, so they can't all fit the limit: if they did, at s tokens each,
    and s lay above e (elsewhere they cost less than the M + 1), the text's k even pieces would
    be more than M, and as L - e <= L / k the M pieces' departures would cost IMBALANCE / M at
    most. Hence the M + 1 pieces hold more than M limits and one overlap, and each of them
    a (M + 1)th of it, rounded down. Words with a character of several tokens are left as they are.
    """
    held, local = (t.n > limit.tokens)[t.text], t.local
    free = t.whole & held & (local > limit.overlap)
    natural = free & (t.kind < 5)
    mark = natural.copy()
    mark[t.first[:-1]] = True
    begins = np.flatnonzero(mark)
    word = np.diff(np.r_[begins, len(mark)])
    slack = 3 if limit.overlap else 0
    long = np.flatnonzero((word + limit.overlap + slack > limit.tokens) & held[begins])
    # nodes of long words, word by word
    many = word[long]
    inner = np.repeat(begins[long] - np.cumsum(many) + many, many) + np.arange(many.sum())
    step = limit.tokens - limit.overlap
    broken = t.broken
    at_start = local[begins[long]] == 0
    left = begins[long] + np.where(at_start, limit.overlap, 0)
    right = begins[long] + many
    cuts = -(-(right - left) // step) - 1
    plain = (broken[right] == broken[np.maximum(begins[long] - np.where(at_start, 0, limit.overlap), 0)]) & (cuts > 0) & (cuts + 1 < 16 * limit.tokens)
    # the k-th cut lies in [right - (cuts + 1 - k) step, left + k step], so between those at equal distance from either end
    from_left = inner - np.repeat(left, many)
    to_right = np.repeat(right, many) - inner
    k = -(-from_left // step)  # the first that may lie so far
    kept = free[inner] & (~np.repeat(plain, many) | (to_right <= (np.repeat(cuts, many) + 1 - k) * step))
    least = np.zeros(len(mark), "int32")
    least[inner] = np.repeat(np.where(plain, (cuts * limit.tokens + limit.overlap) // (cuts + 1), 0), many)
    least[natural] = 0
    chosen = natural.copy()
    chosen[inner[kept]] = True
    at = np.flatnonzero(chosen)
    return t.text[at], at, least[at]


class _Ways:
    """All pieces an optimal plan may have: nodes (a text's beginning, candidates and end) and, per node, where its piece may begin.

    A cut isn't worth more than a better one nearby (less price by over twice IMBALANCE
    times the distance in limits, which is what the move can add to the departures of the
    two pieces): a plan with it gets cheaper by moving the cut there, or by leaving it out
    where another one lies between. So in an optimal plan the better one to the right lies
    beyond the reach of the piece before. The end counts as a better one, without a price.
    """

    def __init__(self, t: _Texts, limit: Limit):
        most, lap = limit.tokens, limit.overlap
        self.text = over = np.flatnonzero(t.n > most)
        text, at, least_at = _candidates(t, limit)
        lane = (np.cumsum(t.n > most, dtype="int32") - 1).take(text)
        #: Steps of each text after its beginning, and the node of its beginning.
        self.steps = np.bincount(lane, minlength=len(over)) + 1
        self.off = np.cumsum(self.steps + 1) - self.steps - 1
        size = int((self.steps + 1).sum())
        where = np.arange(1, len(at) + 1)
        where += lane
        where += lane
        first, n = t.first[over].astype("int32"), t.n[over].astype("int32")
        #: Last and first token of the pieces that end and begin at a node, of the whole list.
        start = np.repeat(first, self.steps + 1)
        end, begin = start.copy(), start.copy()
        end[where] = at
        begin[where] = t.begin_of.take(at - lap) if lap else at
        last = self.off + self.steps
        end[last] = begin[last] = first + n
        kind = np.full(size, -1, "int8")
        kind[where] = t.kind.take(at)
        self.price = np.append(COSTS, 0.0)[kind]
        right = np.full(size, _FAR, "int32")
        better = [np.flatnonzero(kind <= k) for k in range(-1, len(KINDS) - 1)]
        following = [np.repeat(x, np.diff(np.r_[-1, x])) for x in better]
        for k in range(len(KINDS)):
            own = np.flatnonzero(kind == k)
            #: Tokens within which a better cut of each kind is worth the move; the last is the end's.
            worth = ((COSTS[k] - np.append(COSTS, 0.0)) * most / (2 * IMBALANCE) - 3).astype("float32")
            for nearest in following[k::-1]:
                r = nearest.take(own)
                at_r = end.take(r)
                near = at_r - end.take(own) < worth.take(kind.take(r), mode="wrap")
                right[own[near]] = at_r[near]
                own = own[~near]
        least = np.zeros(size, "int32")
        least[where] = least_at
        #: Nodes that begin before a token.
        below = np.zeros(len(t.kind) + 2, "int32")
        np.cumsum(np.bincount(begin, minlength=len(t.kind) + 1), out=below[1:])
        reached = lambda x: below.take(x, mode="clip")
        #: First and beyond-the-last node at which a piece that ends here may begin.
        self.lo = np.maximum(reached(end - most), np.repeat(self.off.astype("int32"), self.steps + 1))
        self.hi = np.maximum(np.minimum(reached(np.minimum(right - most, end - least + 1)), np.arange(size, dtype="int32")), self.lo)
        self.hi[self.off] = self.lo[self.off]
        pieces = -(-(n - lap) // (most - lap))
        even = (n + (pieces - 1) * lap) / pieces
        end -= start
        begin -= start
        self.end, self.begin = end, begin
        unit = np.sqrt(IMBALANCE) / most
        self.x, self.y = (end - np.repeat(even, self.steps + 1)) * unit, begin * unit


def _edges(w: _Joined, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the ways to each node begin and the last end, and of all of them the node where the piece begins, and the piece's departure."""
    lo = w.lo.take(dst).astype("int64")
    many = w.hi.take(dst) - lo
    cut = np.zeros(len(dst) + 1, "int64")
    np.cumsum(many, out=cut[1:])
    lo -= cut[:-1]
    src = np.repeat(lo, many)
    src += np.arange(len(src))
    way = np.repeat(w.x.take(dst), many)
    way -= w.y.take(src)
    way *= way
    return cut, src, way


def _turns(w: _Joined) -> tuple[np.ndarray, np.ndarray]:
    """The nodes after the beginnings by turns, and where each turn begins and the last ends; ways to a turn's nodes begin at nodes of earlier turns.

    After a turn's first node g a text's turn goes on up to the least node j with hi[j] > g,
    whose ways may begin within the turn. All texts take their turns together.
    """
    size = len(w.price)
    nodes = np.arange(size - 1, -1, -1, dtype="int32")
    blocked = np.full(size + 1, size, "int32")
    blocked[w.hi[nodes]] = nodes  # of several the last written, the least, stays
    after = np.minimum.accumulate(blocked[::-1])[::-1][1:]
    turn = np.zeros(size, "int32")
    at, end, lanes, k = w.off + 1, w.off + w.steps, np.arange(len(w.off)), 0
    while len(lanes):
        turn[at[lanes]] = k
        at[lanes] = after[at[lanes]]
        lanes = lanes[at[lanes] <= end[lanes]]
        k += 1
    later = np.delete(nodes[::-1], w.off)
    lane = np.repeat(np.arange(len(w.off)) * k, w.steps)
    turn = (np.maximum.accumulate(turn[later] + lane) - lane).astype("int16" if k < 2**15 else "int32")  # the former is sorted by digits
    return later[np.argsort(turn, kind="stable")], np.r_[0, np.cumsum(np.bincount(turn))]


class _Joined:
    """The ways of all limits, one after the other, so that their texts take their turns together."""

    def __init__(self, ways: list[_Ways]):
        self.off, self.lo, self.hi = (np.concatenate([getattr(w, c) + base for w, base in zip(ways, np.cumsum([0, *[len(w.price) for w in ways[:-1]]]))]) for c in ("off", "lo", "hi"))
        self.text, self.steps, self.price, self.x, self.y, self.end, self.begin = (np.concatenate([getattr(w, c) for w in ways]) for c in ("text", "steps", "price", "x", "y", "end", "begin"))


def _plan(t: _Texts, limits: list[Limit]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(limit's place, text, ends, begins) of the pieces, in tokens of the text."""
    places = [place for place, limit in enumerate(limits) if (t.n > limit.tokens).any()]
    if places:
        ways = [_Ways(t, limits[place]) for place in places]
        of_lane = np.repeat(places, [len(w.text) for w in ways]).tolist()
        joined = _Joined(ways)
        del ways
        for place, (i, ends, begins) in zip(of_lane, _cheapest(joined)):
            yield place, i, ends, begins


def _cheapest(w: _Joined) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Text, ends and begins of its pieces. All texts advance together, turn by turn; the ways of some turns are made at once."""
    turn, bound = _turns(w)
    work = np.r_[0, np.cumsum((w.hi - w.lo)[turn] + 1, dtype="int64")][bound]
    cost = np.full(len(w.price), np.inf)
    cost[w.off] = 0.0
    j = 0
    while j < len(bound) - 1:
        to = max(j + 1, int(np.searchsorted(work, work[j] + WAYS_AT_ONCE, side="right")) - 1)
        dst = turn[bound[j] : bound[to]]
        cut, src, way = _edges(w, dst)
        some = np.flatnonzero(cut[1:] > cut[:-1])
        begins, dst = cut.take(some), dst.take(some)
        price = w.price.take(dst)
        at = bound[j : to + 1] - bound[j]
        e, d = cut[at].tolist(), np.searchsorted(some, at).tolist()
        for e0, e1, d0, d1 in zip(e, e[1:], d, d[1:]):
            if d0 < d1:
                total = cost.take(src[e0:e1])
                total += way[e0:e1]
                cost[dst[d0:d1]] = np.minimum.reduceat(total, begins[d0:d1] - e0) + price[d0:d1]
        j = to
    lanes, at, found = np.arange(len(w.text)), w.off + w.steps, []
    while len(lanes):
        cut, src, way = _edges(w, at)
        way += cost.take(src)
        row = np.repeat(np.arange(len(at)), np.diff(cut))
        least = np.flatnonzero(way == np.minimum.reduceat(way, cut[:-1])[row])
        prior = src[least[np.r_[np.diff(row[least]) > 0, True]]]  # the last of equals
        found.append((lanes, w.end[at], w.begin[prior]))
        more = prior > w.off[lanes]
        lanes, at = lanes[more], prior[more]
    lane, end, begin = (np.concatenate(x[::-1]) for x in zip(*found))
    by = np.argsort(lane, kind="stable")
    cut = np.cumsum(np.bincount(lane))[:-1]
    yield from zip(w.text.tolist(), np.split(end[by], cut), np.split(begin[by], cut))


def _pieces(keys: list, texts: list[bytes], limits: list[Limit], vocabulary: str) -> Iterator[tuple]:
    """(key, limit's place, and of all its pieces from, to, kind of the cut after it, and text), for a handful of texts."""
    least = min(x.tokens for x in limits)
    kept, ids = [], []
    for i, x in enumerate(texts):
        found = encode(vocabulary, x.decode("utf-8"))
        if len(found) > least:
            kept.append(i)
            ids.append(np.frombuffer(array("i", found), "int32"))
    if not kept:
        return
    t = _Texts([texts[i] for i in kept], ids, vocabulary)
    names = np.array([*KINDS, FINAL], object)
    for place, i, ends, begins in _plan(t, limits):
        first = t.first[i]
        cut = t.kind[first : first + t.n[i]][ends[:-1]]
        a, b = (t.at[first + begins] - t.at[first]).tolist(), (t.at[first + ends] - t.at[first]).tolist()
        own = texts[kept[i]]
        yield keys[kept[i]], place, begins, ends, names[np.r_[cut, len(KINDS)]], [own[x:y] for x, y in zip(a, b)]


def _batch(rows: list[tuple], most: np.ndarray, overlap: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    keys, places, begins, ends, cuts_, texts = zip(*rows)
    many = np.array([len(x) for x in begins])
    place = np.repeat(np.array(places), many)
    number = np.arange(many.sum(), dtype="int32") - np.repeat(np.cumsum(many) - many, many).astype("int32")
    a, b = np.concatenate(begins).astype("int32"), np.concatenate(ends).astype("int32")
    key = pa.array(keys, schema.field(0).type).take(pa.array(np.repeat(np.arange(len(keys)), many)))
    columns = [key, pa.array(most[place]), pa.array(overlap[place]), pa.array(number), pa.array(a), pa.array(b), pa.array(b - a), pa.array(np.concatenate(cuts_), pa.string()), pa.array([x for own in texts for x in own], pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def split(docs: DataFrame, limits: list[tuple[int, int]], key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of the texts over a limit: key, max_tokens, solape_tokens, pieza, desde_token, hasta_token, n_tokens, corte, texto.

    limits: (tokens, overlap) pairs; one limit may come with several overlaps. A text within a limit gives no rows for it, nor does a
    null or empty one. Pieces hold at most the limit; each shares the overlap's tokens with
    the one before, or up to three more where its first character would be cut otherwise.
    corte is the kind of boundary after the piece, ``fin`` after the last. Texts are cut
    between tokens only; where there is no natural boundary, between two tokens that don't
    share a character. Repeated rows are cut each for itself.

    Method: dynamic programming over boundary positions. Each text is encoded once; the
    cuts with the least sum of penalties and of squared departures from the even size are
    found for all texts of a batch and all limits at once. Boundaries and pieces are left
    out only where a plan with them can be made cheaper, so the sum is the least over all
    boundaries between characters. Whole texts are worked on, however long they are.
    """
    own = sorted({Limit(int(a), int(b or 0)) for a, b in limits}, key=lambda x: (x.tokens, x.overlap))
    if not own:
        raise ValueError("no limits given")
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, max_tokens int, solape_tokens int, pieza int, desde_token int, hasta_token int, n_tokens int, corte string, texto string"
    least = own[0].tokens
    most_of, overlap_of = (np.array([getattr(x, c) for x in own], "int32") for c in ("tokens", "overlap"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_type: pa.Schema | None = None
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            out_type = pa.schema([(key, batch.schema.field(0).type), *[(c, pa.int32()) for c in ("max_tokens", "solape_tokens", "pieza", "desde_token", "hasta_token", "n_tokens")], ("corte", pa.string()), ("texto", pa.string())])
            a = held = 0
            for b, x in enumerate(texts, 1):
                held += len(x)
                if held >= BYTES_AT_ONCE or b == len(texts):
                    ready, n = [], 0
                    for x in _pieces(keys[a:b], texts[a:b], own, vocabulary):
                        ready.append(x)
                        n += len(x[2])
                        if n >= PIECES_AT_ONCE:
                            yield _batch(ready, most_of, overlap_of, out_type)
                            ready, n = [], 0
                    if ready:
                        yield _batch(ready, most_of, overlap_of, out_type)
                    a, held = b, 0

    # a text of no more bytes than the least limit has no more tokens
    return docs.select(key, text).filter(F.octet_length(text) > least).mapInArrow(run, schema)


def cuts(pieces: DataFrame) -> DataFrame:
    """Per limit and overlap: texts, pieces, tokens and how many pieces end at each kind of boundary."""
    return pieces.groupBy("max_tokens", "solape_tokens").agg(F.count_if(F.col("pieza") == 0).alias("textos"), F.count("*").alias("piezas"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("mayor"), *[F.count_if(F.col("corte") == k).alias(k) for k in KINDS])
