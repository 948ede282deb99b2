import itertools

import numpy as np
import pytest

from geomotif.llm import webp


def picture(h, w, colours, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (colours, 4), dtype=np.uint8)
    p = base[rng.integers(0, colours, (h, w))]
    p[h // 2 :, : w // 2] = p[: h - h // 2, : w // 2]
    return p


SHAPES = [(1, 1), (5, 7), (13, 33)]


@pytest.mark.parametrize("h,w", SHAPES)
@pytest.mark.parametrize("colours", [1, 2, 3, 12, 200])
@pytest.mark.parametrize("cache,matches,meta", [(0, False, 0), (3, False, 0), (0, True, 2), (5, True, 3), (1, True, 0)])
def test_round_trip_of_every_transform(h, w, colours, cache, matches, meta):
    p = picture(h, w, colours, h * 100 + colours)
    for n in range(4):
        for t in itertools.permutations((webp.PREDICTOR, webp.CROSS, webp.GREEN), n):
            media = webp.encode(p, t, cache, matches, meta_bits=meta)
            assert np.array_equal(webp.decode(media), p)
            assert np.array_equal(webp.decode_many([media])[0], p)
    if colours <= 200:
        media = webp.encode(p, (webp.PALETTE,), cache, matches, meta_bits=meta)
        assert np.array_equal(webp.decode(media), p)


def test_every_predictor_mode():
    p = picture(20, 21, 300, 5)
    for mode in range(14):
        media = webp.encode(p, (webp.PREDICTOR,), modes=np.full((3, 3), mode))
        assert np.array_equal(webp.decode(media), p)


def test_predictions_by_hand():
    one = lambda *v: np.array([v])
    left, top, right, corner = one(10, 20, 30, 40), one(50, 60, 70, 80), one(1, 2, 3, 4), one(5, 200, 15, 90)
    want = {
        0: (0, 0, 0, 255), 1: (10, 20, 30, 40), 2: (50, 60, 70, 80), 3: (1, 2, 3, 4), 4: (5, 200, 15, 90),
        5: (27, 35, 43, 51), 6: (7, 110, 22, 65), 7: (30, 40, 50, 60), 8: (27, 130, 42, 85), 9: (25, 31, 36, 42),
        10: (16, 70, 29, 53), 11: (50, 60, 70, 80), 12: (55, 0, 85, 30), 13: (42, 0, 67, 45),
    }
    for mode, v in want.items():
        assert tuple(webp.predict(mode, left, top, right, corner)[0]) == v, mode


def test_fast_paths_equal_the_plain_ones():
    rng = np.random.default_rng(3)
    files, want = [], []
    for h in (1, 2, 9, 40):
        for kinds in (1, 2, 60, 256):
            s = rng.choice(rng.integers(0, 256, kinds), h * 192).astype(np.uint8)
            files.append(webp.encode_samples(s, 64, h))
            want.append(s)
    for m, p, s in zip(files, webp.decode_many(files), want, strict=True):
        assert np.array_equal(p[..., :3].ravel(), s) and (p[..., 3] == 255).all()
        assert np.array_equal(webp.decode(m), p)


def test_damaged_files_raise():
    media = webp.encode_samples(np.arange(192, dtype=np.uint8), 64, 1)
    with pytest.raises(ValueError):
        webp.decode(media[:40])
    with pytest.raises(ValueError):
        webp.decode(b"RIFF" + media[5:])


def test_code_lengths_are_complete_and_limited():
    counts = np.array([2**k for k in range(25)] + [0, 0, 1])
    for limit in (7, 11, 15):
        n = webp.code_lengths(counts, limit)
        assert n.max() <= limit and sum(2.0**-x for x in n if x) == 1


def test_texts_use_what_the_format_has():
    """Stored texts hold transforms, back-references and colour caches where these are shorter."""
    rng = np.random.default_rng(8)
    prose = (" ".join(rng.choice("the of and harbour winter letter bridge garden in on with to".split(), 4000))).encode()
    kinds = {"prose": prose, "line": b"one line that comes again and again, " * 300, "few": bytes(rng.choice(list(b"ab"), 4000)), "grey": bytes(np.repeat(rng.integers(0, 256, 4000), 3).astype(np.uint8)), "slope": bytes((np.arange(40000) // 3 % 256).astype(np.uint8))}
    seen, files, want = {}, [], []
    for name, text in kinds.items():
        h = -(-len(text) // 192)
        s = np.frombuffer(text.ljust(192 * h), np.uint8)
        files.append(webp.encode_samples(s, 64, h))
        want.append(s.reshape(h, 64, 3))
        bits = webp.Bits(webp.unwrap(files[-1]))
        _, _, coded, transforms = webp.read_head(bits)
        cache, groups, *_ = webp.read_coding(bits, coded, h, True)
        seen[name] = ({k for k, *_ in transforms}, cache > 0, np.count_nonzero(groups[0][4]) > 1, len(files[-1]))
        assert np.array_equal(webp.decode(files[-1])[..., :3], want[-1])
    for p, w in zip(webp.decode_many(files * 9), want * 9, strict=True):
        assert np.array_equal(p[..., :3], w)
    assert seen["prose"][1] and seen["line"][2] and seen["line"][3] < 1000
    assert set.union(*(x[0] for x in seen.values())) >= {webp.PALETTE, webp.GREEN}


def test_running_predictors_equal_the_plain_ones():
    p = picture(9, 14, 40, 3)
    for mode in (1, 2):
        own = webp.predictor(p, np.full((2, 2), mode), 3, True)
        mixed = np.full((2, 2), mode)
        mixed[1, 1] = 3 - mode
        plain = webp.predictor(p, mixed, 3, True)
        assert np.array_equal(own[:8, :8], plain[:8, :8])
        assert np.array_equal(webp.predictor(own, np.full((2, 2), mode), 3, False), p)
        assert np.array_equal(webp.predictor(plain, mixed, 3, False), p)


def test_damaged_streams_are_told():
    rng = np.random.default_rng(2)
    s = np.frombuffer(b"some words of a text, some words of another text; " * 40, np.uint8)
    good = webp.encode_samples(s[:1920], 64, 10)
    for _ in range(60):
        bad = bytearray(good)
        bad[int(rng.integers(25, len(bad)))] ^= int(rng.integers(1, 256))
        try:
            got = webp.decode_many([bytes(bad)] * 30)[0]
        except (ValueError, IndexError, KeyError):
            continue
        assert got.shape == (10, 64, 4)
    with pytest.raises(ValueError):
        webp.decode_many([good[:-40]] * 30)


def test_pixels_without_repeated_windows_are_not_argsorted(monkeypatch):
    def dear(*a, **k):
        raise AssertionError("argsort")

    v = np.arange(1000, dtype=np.uint32)
    twice = np.concatenate([v[:50], v[:50]])
    assert webp._copies(twice) == [(50, 50, 50)]
    monkeypatch.setattr(webp.np, "argsort", dear)
    assert webp._copies(v) == []
