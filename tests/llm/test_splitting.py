import random

import numpy as np
import pytest

from telar.llm import splitting as S
from telar.llm.splitting import Limit, cuts, split
from telar.llm.tokens import PATTERN, VOCABULARY, encode, encoding, token_count

PROSE = "# Control\n\nLa gestante refiere movimientos. Se indica reposo y agua.\r\n\r\n## Plan\nVolver en 4 semanas; ¿dudas? Llamar al 507-123.\n"


def text(seed, n):
    r = random.Random(seed)
    bits = ["reposo ", "agua. ", "\n", "\n\n", "## Plan\n", "é́", "😀", "日本語", "0123456789", "x" * 40, "   ", "\r\n", "it's ", "!!'s "]
    return "".join(r.choice(bits) for _ in range(n))


def flat(pieces):
    return [(k, place, n, *x) for k, place, *columns in pieces for n, x in enumerate(zip(*columns))]


@pytest.mark.parametrize("seed", range(12))
def test_pieces_make_up_the_text_within_the_limit(seed):
    t = text(seed, 300)
    for limit in (Limit(16, 0), Limit(24, 8), Limit(128, 0), Limit(64, 16)):
        pieces = flat(S._pieces([7], [t.encode()], [limit], VOCABULARY))
        if not pieces:
            assert len(encode(VOCABULARY, t)) <= limit.tokens
            continue
        out, end = b"", 0
        ids = encode(VOCABULARY, t)
        at = np.cumsum([0] + [len(encoding(VOCABULARY).decode_single_token_bytes(i)) for i in ids])
        for i, (_, _, n, a, b, kind, piece) in enumerate(pieces):
            assert n == i and a < b and b > end and b - a <= limit.tokens
            assert piece == t.encode()[at[a] : at[b]]
            assert len(encode(VOCABULARY, piece.decode())) <= limit.tokens
            if i:
                assert limit.overlap <= end - a <= limit.overlap + 3
            out += t.encode()[at[end] : at[b]]
            end = b
        assert out == t.encode() and pieces[-1][5] == S.FINAL


def test_dynamic_programming_finds_the_cheapest_cuts():
    """Against all ways through the same candidates."""
    limit = Limit(16, 4)
    t = PROSE * 2
    ids = np.array(encode(VOCABULARY, t))
    texts = S._Texts([t.encode()], [ids], VOCABULARY)
    at = S._candidates(texts, limit)[1]
    n = len(ids)
    whole = texts.whole
    pieces = -(-(n - limit.overlap) // (limit.tokens - limit.overlap))
    even = (n + (pieces - 1) * limit.overlap) / pieces

    def begin(cut):
        x = cut - limit.overlap
        while not whole[x]:
            x -= 1
        return x

    price = lambda a, b: S.IMBALANCE * ((b - a - even) / limit.tokens) ** 2
    best = {n: 0.0}

    def cost(cut):  # of what lies after the cut
        start = begin(cut) if cut else 0
        if (cut, "x") not in best:
            ways = [price(start, b) + (S.COSTS[texts.kind[b]] + cost(b) if b < n else 0) for b in [*at.tolist(), n] if b > cut and b - start <= limit.tokens]
            best[cut, "x"] = min(ways, default=np.inf)
        return best[cut, "x"]

    (_, _, ends, begins), = S._plan(texts, [limit])
    got = sum(price(a, b) for a, b in zip(begins, ends)) + sum(S.COSTS[texts.kind[b]] for b in ends[:-1])
    assert abs(got - cost(0)) < 1e-9


def cheapest(t, limit):
    """The least cost of cutting a text, over all boundaries between characters."""
    n = len(t.kind)
    ends = np.array([0, *[x for x in range(limit.overlap + 1, n) if t.whole[x]], n])
    begins = np.maximum.accumulate(np.where(t.whole, np.arange(n), 0))[np.maximum(ends - limit.overlap, 0) % n]
    pieces = -(-(n - limit.overlap) // (limit.tokens - limit.overlap))
    even = (n + (pieces - 1) * limit.overlap) / pieces
    cost = np.zeros(len(ends))
    for j in range(1, len(ends)):
        size = ends[j] - begins[:j]
        ways = cost[:j] + S.IMBALANCE * ((size - even) / limit.tokens) ** 2
        cost[j] = ways[size <= limit.tokens].min(initial=np.inf) + (S.COSTS[t.kind[ends[j]]] if ends[j] < n else 0)
    return cost[-1], even


@pytest.mark.parametrize("limit", [Limit(16, 0), Limit(24, 8), Limit(33, 25), Limit(128, 0), Limit(256, 32), Limit(512, 64)])
def test_no_boundary_gives_cheaper_cuts(limit):
    texts = [text(s, 900) for s in range(5)] + [PROSE * 30, "palabra " * 700, "y" * 5000, "uno, dos. " * 3 + "x1y2" * 900 + "\nfin. " * 90]
    for x in texts:
        ids = np.array(encode(VOCABULARY, x))
        t = S._Texts([x.encode()], [ids], VOCABULARY)
        for _, _, ends, begins in S._plan(t, [limit]):
            least, even = cheapest(t, limit)
            got = (S.IMBALANCE * ((ends - begins - even) / limit.tokens) ** 2).sum() + S.COSTS[t.kind[ends[:-1]]].sum()
            assert abs(got - least) < 1e-6


@pytest.mark.parametrize("seed", range(6))
def test_words_over_the_limit_are_cut_at_the_least_cost(seed):
    """Unbroken words from half a limit to many limits, between all kinds of boundaries, at the ends of texts too."""
    r = random.Random(seed)
    for limit in (Limit(16, 0), Limit(24, 8), Limit(40, 5), Limit(64, 0), Limit(33, 25)):
        for _ in range(12):
            word = lambda: "".join(r.choice("qxzjkvw0123") for _ in range(int(limit.tokens * r.choice([0.4, 0.9, 1.0, 1.1, 1.6, 2.0, 2.1, 3.5, 7]) * 1.5)))
            gap = lambda: r.choice([" ", " ", "\n", "\n\n", ". ", "\n# ", " a ", " a b. c\n", " é́ ", "😀"])
            x = r.choice(["", gap()]) + "".join(word() + gap() for _ in range(r.randint(1, 5))) + r.choice(["", word()])
            t = S._Texts([x.encode()], [np.array(encode(VOCABULARY, x))], VOCABULARY)
            for _, _, ends, begins in S._plan(t, [limit]):
                least, even = cheapest(t, limit)
                got = (S.IMBALANCE * ((ends - begins - even) / limit.tokens) ** 2).sum() + S.COSTS[t.kind[ends[:-1]]].sum()
                assert abs(got - least) < 1e-6, (limit, x)


def test_one_limit_with_two_overlaps(spark):
    got = split(spark.createDataFrame([(1, PROSE * 30)], "doc_id long, text string"), [(128, 0), (128, 32)])
    n = {r.solape_tokens: r.piezas for r in cuts(got).collect()}
    assert set(n) == {0, 32} and n[32] > n[0]


def test_cuts_prefer_natural_boundaries():
    t = "".join(f"# Parte {i}\n\n" + "La gestante refiere movimientos fetales normales. " * 6 + "\n\n" for i in range(12))
    kinds = [x[5] for x in flat(S._pieces([1], [t.encode()], [Limit(128, 0)], VOCABULARY))]
    assert set(kinds[:-1]) == {"titulo"}


def test_line_ends_are_not_cut():
    t = "uno dos tres cuatro\r\n\r\n" * 60
    pieces = flat(S._pieces([1], [t.encode()], [Limit(32, 0)], VOCABULARY))
    assert len(pieces) > 5 and not any(x[-1].startswith(b"\n") for x in pieces) and {x[5] for x in pieces[:-1]} == {"parrafo"}


def test_split_over_a_table(spark):
    long = "palabra " * 40_000
    rows = [(1, None), (2, ""), (3, "corto"), (4, PROSE * 20), (4, PROSE * 20), (5, "y" * 50_000), (6, long), (None, PROSE * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as texto", "1 as pieza")
    out = split(df, [(128, 0), (256, 32)])
    got = out.collect()
    assert {r.doc_id for r in got} == {4, 5, 6, None} and max(r.n_tokens for r in got if r.max_tokens == 128) <= 128
    assert "".join(r.texto for r in sorted((r for r in got if r.doc_id == 6 and r.max_tokens == 128), key=lambda r: r.pieza)) == long
    assert sorted(r.pieza for r in got if r.doc_id == 4 and r.max_tokens == 256) == sorted(2 * list(range(1 + max(r.pieza for r in got if r.doc_id == 4 and r.max_tokens == 256))))
    assert cuts(out).filter("max_tokens = 128").first().textos == 5
    assert split(df.limit(0), [(128, 0)]).count() == 0


def test_limits_must_leave_room():
    for bad in ((8, 1), (128, 121), (128, -1)):
        with pytest.raises(ValueError):
            Limit(*bad)


def test_counts_and_long_white_space(spark):
    long = " " * 1_500_000 + "x\n y"
    df = spark.createDataFrame([("hola mundo",), ("",), (None,), (long,)], "t string")
    a, b, c, d = [r.n for r in df.select(token_count(df.t).alias("n")).collect()]
    assert (a, b, c) == (len(encoding(VOCABULARY).encode_ordinary("hola mundo")), 0, 0) and d > 1000
    import regex

    for t in (PROSE, text(3, 200)):
        e = encoding(VOCABULARY)
        assert [x for p in regex.finditer(PATTERN, t) for x in e._encode_single_piece(p[0])] == e.encode_ordinary(t)
