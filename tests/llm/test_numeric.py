"""The array kernels against plain brute force; no Spark session needed."""

import math
import os
import random
import time

import numpy as np
import pytest

from textquarry.llm import html, language, mixing, neardup_vectors, pieces, toxicity, transport
from textquarry.llm.textnum import BLANKS, NON_WORD, PIECE, shingles, word_runs, words_by_doc


def test_word_hashes_do_not_depend_on_place():
    texts = ["Hello  World\nfoo", None, "", "hello world", "x" * 10]
    got = dict(words_by_doc(texts, BLANKS))
    assert [len(got[i]) for i in range(5)] == [3, 0, 0, 2, 1]
    assert list(got[0][:2]) == list(got[3])


def test_long_texts_are_cut_without_losing_words():
    text = " ".join(f"w{i % 977}" for i in range(700_000))
    assert len(text) > 3 * PIECE
    (_, words), = words_by_doc([text], BLANKS)
    assert len(words) == 700_000 and len(np.unique(words)) == 977


def test_prefix_hashes():
    (w,) = word_runs(["idiots idiot id"], NON_WORD)
    p = w.prefix(5)
    assert p[0] == p[1] != p[2] and w.hash[2] == p[2]


def test_shingles_of_short_texts():
    (_, w), (_, v) = words_by_doc(["a b c", "a b c d e f"], BLANKS)
    assert len(shingles(w)) == 1 and len(shingles(v)) == 2 and len(shingles(w[:0])) == 0


def _segments(s):
    best = None
    for i in range(len(s)):
        for j in range(i, len(s)):
            t = s[i : j + 1].sum()
            if t > 1e-12 and (best is None or t > best[0] + 1e-12):
                best = (t, i, j)
    if best is None:
        return []
    _, i, j = best
    return _segments(s[:i]) + [(i, j)] + [(a + j + 1, b + j + 1) for a, b in _segments(s[j + 1 :])]


def test_maximal_segments_against_definition():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.normal(-0.2, 1, rng.integers(0, 25))
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == _segments(s)


def test_automaton_knows_all_substrings_and_parse_is_greedy():
    rng = random.Random(5)
    for _ in range(30):
        s = [rng.randrange(3) for _ in range(rng.randrange(1, 60))]
        step = language.suffix_automaton(np.array(s), 4)
        t = [rng.randrange(4) for _ in range(50)]
        n, i, texts = 0, 0, "".join(map(str, s))
        while i < len(t):
            k = i
            while k < len(t) and "".join(map(str, t[i : k + 1])) in texts:
                k += 1
            i, n = (k if k > i else i + 1), n + 1
        lanes = np.array(t, np.int32)[:, None]
        got = language.phrases(lanes, np.array([len(t)]), step)[0]
        assert got == n


def test_automata_of_large_alphabets_stay_small():
    rng = np.random.default_rng(3)
    a = language.suffix_automaton(rng.integers(1, 4200, 24_000), 4201)
    assert a.keys.nbytes + a.to.nbytes < 8 << 20
    path = [int(a.first[5])]
    assert a.step(np.array([0, 0, -1]), np.array([5, 0, 5])).tolist() == [path[0], -1, -1]


def test_symbols_keep_letters_only():
    assert "".join(map(chr, language.symbols("हिन्दी में"))) == "हिन्दी में" and len(language.symbols("\u0301 1")) == 0
    assert "".join(map(chr, language.symbols("Él,  12 ño!!"))) == "él ño "
    assert len(language.symbols("12 !")) == len(language.symbols(None)) == len(language.symbols("")) == 0


@pytest.mark.parametrize(
    "weights", [{"a": 1.0}, {"a": 1, "b": 1, "c": 5}, {f"s{i:02}": i + 0.3 for i in range(17)}, {"a": 2000, "b": 1, "c": 1}, {"a": 0.1, "b": 0.2, "c": 1e-3}]
)
def test_pfair_windows_and_lag(weights):
    w = mixing.whole_weights(weights)
    assert all(abs(w[s] * sum(weights.values()) / (weights[s] * sum(w.values())) - 1) < 1e-9 for s in w)
    total = sum(w.values())
    plan = mixing.edf(dict.fromkeys(w, 500), w)
    assert sorted((s, k) for s, k, *_ in plan) == sorted((s, k) for s in w for k in range(500))
    done = dict.fromkeys(w, 0)
    for n, (s, k, release, slot, due) in enumerate(plan):
        assert k == done[s] and release == k * total // w[s] <= slot < due == -(-(k + 1) * total // w[s])
        done[s] += 1
        if max(done.values()) < 500:  # nothing is used up yet: no slot is skipped
            assert slot == n
        if n + 1 < len(plan):  # against the target itself, at the next slot's clock
            clock = plan[n + 1][3]
            assert all(abs(done[x] * total - clock * w[x]) < total for x in w if done[x] < 500)


def test_schedules_of_odd_weights():
    plan = mixing.edf({"a": 700, "b": 40, "c": 3, "d": 0, "e": 5, "f": 4}, mixing.whole_weights({"a": 1.0, "b": 2.0, "c": 0.5, "d": 1.0, "e": 0, "f": 0.0}))
    assert len(plan) == 752 and [r[0] for r in plan[743:]] == list("efefefefe")
    assert [r[0] for r in mixing.edf({"a": 2, "b": 2}, {"a": 0, "b": 0})] == list("abab")
    tiny = mixing.edf({"a": 3, "b": 3}, mixing.whole_weights({"a": 1, "b": 1.1e-6}))
    assert [r[0] for r in tiny] == ["a", "a", "a", "b", "b", "b"] and tiny[3][2:] == (0, 3, -(-(10**7 + 11) // 11))
    many = mixing.edf({f"s{i}": 1 + i % 7 for i in range(10_000)}, {f"s{i}": 1 + i % 97 for i in range(10_000)})
    assert len(many) == sum(1 + i % 7 for i in range(10_000))
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.whole_weights({"a": 1, "b": bad})


@pytest.mark.parametrize("n", [64, 128, 184, 320, 5504, transport.UNIT - 2, transport.UNIT, transport.UNIT + 64, 9 * transport.UNIT + 1])
def test_transport_round_trip(n):
    data = os.urandom(n)
    stream = transport.mux(data)
    back = transport.demux(stream)
    units = -(-n // transport.UNIT)
    assert back.payload == data and len(stream) % 188 == 0
    assert list(back.pts) == [i * transport.CLOCK_STEP for i in range(units)]
    assert list(back.random_access) == list(range(0, units, transport.GOP))


def test_damaged_streams_are_refused():
    stream = bytearray(transport.mux(os.urandom(4000)))
    for at, value in ((0, 0x48), (3 * 188 + 3, stream[3 * 188 + 3] ^ 1), (10, stream[10] ^ 4)):
        broken = bytearray(stream)
        broken[at] = value
        with pytest.raises(ValueError):
            transport.demux(bytes(broken))
    with pytest.raises(ValueError):
        transport.demux(bytes(stream[:-188 * 2 + 5]))


def _nbest(lat, text, n):
    s = chr(pieces.SPACE) + "".join(chr(pieces.SPACE) if c == " " else chr(pieces.LITERAL) if ord(c) == pieces.SPACE else c for c in text)
    k = [[] for _ in range(len(s) + 1)]
    k[0] = [0]
    for j in range(1, len(s) + 1):
        c = []
        for i in range(max(0, j - lat.longest), j):
            p = lat.id_of.get(s[i:j])
            if p is not None:
                c += [x + lat.v.scores[p] for x in k[i]]
        if not lat.sym_of[ord(s[j - 1])]:
            c += [x + lat.unknown for x in k[j - 1]]
        k[j] = sorted(c, reverse=True)[:n]
    return k[-1]


@pytest.fixture(scope="module")
def lattice():
    if not os.path.exists(pieces.MODEL_PATH):
        pytest.skip("no vocabulary file here")
    return pieces.Lattice(pieces.Vocabulary.load(pieces.MODEL_PATH))


def test_nbest_scores_and_round_trip(lattice):
    rng = random.Random(7)
    words = ["the", "ontion", "Reheating", "straße", "ñandú", "日本語", "a", "", "x1.5%", "\n", "▁", "\U0001f600", "e" * 40]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(60)] + ["", " ", "  double", None]
    for n in (1, 4, 7):
        for text, (ids, score, best) in zip(texts, lattice.encode(texts, n)):
            assert lattice.decode(ids.tolist()) == (text or "")
            assert [b[0] for b in best] == (_nbest(lattice, text, n) if text else [0]) and best[0][0] == score
            paths = [detour(ids.tolist(), changes) for _, _, changes in best]
            assert len(set(map(tuple, paths))) == len(paths) and all(lattice.decode(p) == (text or "") for p in paths)
            byte = set(lattice.byte_ids)
            for p, (total, size, _) in zip(paths, best):
                assert len(p) == size
                if not byte & set(p):
                    assert sum(lattice.v.scores[i] for i in p) == total


def detour(ids, changes):
    out, upto = [], 0
    for at, drop, new in changes:
        out += ids[upto:at] + new
        upto = at + drop
    return out + ids[upto:]


@pytest.mark.parametrize("unit", ["-", "a", "=", "ab", "\u2581", " ", "日", "-=", "aGVsbG8"])
def test_long_unbroken_texts_take_seconds(lattice, unit):
    text = unit * (100_000 // len(unit))
    began = time.time()
    (ids, _, best), *_ = lattice.encode([text], 4)
    lattice.clear()
    assert time.time() - began < 20 and lattice.decode(ids.tolist()) == text and 1 <= len(best) <= 4
    short = unit * (60 // len(unit))
    (_, _, best), *_ = lattice.encode([short], 4)
    assert [b[0] for b in best] == _nbest(lattice, short, 4)


def test_chunks_that_share_a_key_are_told_apart(lattice):
    texts = [" stone", " water"]
    first = [x[0].tolist() for x in lattice.encode(texts, 1)]
    lattice.clear()
    list(lattice.encode(texts[:1], 1))
    lattice.cps[-1] ^= 1  # what is kept under the key is another chunk now
    assert [x[0].tolist() for x in lattice.encode(texts, 1)] == first and lattice.clash
    lattice.clear()


def test_scores_of_ranks_follow_zipf():
    given = pieces.log_probabilities([-float(i) for i in range(1000)])
    assert given == sorted(given, reverse=True) and abs(sum(math.exp(x / pieces.UNIT) for x in given) - 1) < 1e-4
    assert pieces.log_probabilities([-1.5, -2.0]) == [-1_500_000, -2_000_000]


def test_very_long_text_in_parts(lattice):
    text = "some words and naïve ones, " * 60_000
    ((ids, score, best),) = lattice.encode([text], 2)
    assert len(text) > pieces.RUN and lattice.decode(ids.tolist()) == text
    assert best[1][0] <= best[0][0] == score


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We bake</div><article><h1>Head &amp; line</h1><p>One<br>two&nbsp; three<p><b>Four</b> five
<div class="comments"><p>first!</p></div><aside>side</aside><script>var t="</p>";</script></article><footer>&copy; us</footer></body>"""


def test_main_text_of_a_page():
    assert html.main_text(html.parse(PAGE)) == "Head & line\n\nOne two three\n\nFour five"


def test_blocks_know_what_they_lie_in():
    page = "<body><div>Join now</div><p>Body text</p><article><p>Quoted</p><div>Shop <i>here</i></div></article></body>"
    found = html.text_blocks(html.parse(page))
    assert [(b.text, len(b.cut), len(b.prose), b.main) for b in found] == [
        ("Join now", 1, 0, False), ("Body text", 1, 0, False), ("Quoted", 0, 1, True), ("Shop here", 1, 0, True)
    ]
    again = html.text_blocks(html.parse(f"<main>{page}</main>"))
    assert again[3].cut == found[3].cut and again[2].prose == found[2].prose


@pytest.mark.parametrize("deep", ["<div>", "<b>", "<ul><li>", "<p><b>", "<span>x", "<div>x"])
def test_deep_and_misnested_markup_takes_linear_time(deep):
    began = time.time()
    for close in ("</x>", "</p>", "</div>", "<p>", ""):
        html.main_text(html.parse(deep * 20_000 + close * 20_000))
    assert time.time() - began < 20


@pytest.mark.parametrize("bad", ["", "<", "<p", "a < b", "</p></p>", "<p class='x", "<!-- open", "<script>x", "&#x41;&bogus;", "<p>a</div>b"])
def test_broken_markup_never_fails(bad):
    html.main_text(html.parse(bad))


def test_unit_rows_refuse_what_has_no_direction():
    x, ok = neardup_vectors.unit_rows([[1.0, 0.0], None, [0.0, 0.0], [float("nan"), 1.0], [1.0], [1e200, 1e200]], 2)
    assert list(ok) == [True, False, False, False, False, True] and np.allclose(np.linalg.norm(x[ok], axis=1), 1)
