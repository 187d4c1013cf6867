"""Parts that need no Spark, against plain versions."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import arrays, common, factorisation, langid, language_model, licences, minhash, mixing, ogg, packing, quality_rules, toxicity
from foliant.llm.labelled import without_copies

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.text(alphabet=st.sampled_from("ab cé\n\t\x0b\x0c\r\x1c  #*|<ß漢😀.A"), max_size=60)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_are_the_pattern(t):
    assert [w.decode() for w in t.encode().split()] == WORD.findall(t)


def test_windows_differ_and_repeat():
    c = common.HashCache()
    h = common.word_hashes([b"a", b"b", b"c", b"a", b"b", b"c"], c)
    w = common.window_hashes(h, 3)
    assert len(w) == 4 and w[0] == w[3] and len(set(w.tolist())) == 3
    assert len(common.window_hashes(h, 7)) == 0


# --- packing


@pytest.fixture(scope="module")
def ids():
    return packing.TokenIds()


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_ids_are_the_tokenizers(ids, t):
    assert ids(t) == ids.full.encode(t, add_special_tokens=False).ids


def test_ids_of_odd_texts(ids):
    for t in ("", " ", "  \n\n ", "a<|endoftext|>b", "<|endoftext|>", "é" * 500, "don't 12345 　x", "\x00\x01", "漢字かな交じり文" * 40):
        assert ids(t) == ids.full.encode(t, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@given(st.lists(st.integers(1, 16), max_size=120), st.integers(1, 8))
@settings(max_examples=200, deadline=None)
def test_best_fit_is_the_plain_one(lengths, places):
    p, plain, made = packing.BestFit(16, places), {}, 0
    for n in lengths:
        got = p.add(n)
        fits = {b: f for b, f in plain.items() if f >= n}
        if n == 16:
            expected = (made, 0)
            made += 1
        elif fits:
            best = min(fits.values())
            assert plain[got[0]] == best
            expected = (got[0], 16 - best)
        else:
            if len(plain) >= places:
                tightest = min(plain.values())
                closing = [b for b, f in plain.items() if f == tightest]
                plain.pop(max(closing, key=lambda b: p_order.index(b)) if (p_order := list(plain)) else None)
                # which of equally full ones closes is free; take the packer's
                open_now = {b for bins in p.by_free for b in bins}
                for b in list(plain):
                    if b not in open_now:
                        plain.pop(b)
                for b in closing:
                    if b in open_now and b != got[0]:
                        plain[b] = tightest
            expected = (made, 0)
            made += 1
        assert got == expected
        left = 16 - got[1] - n
        plain.pop(got[0], None)
        if left:
            plain[got[0]] = left
        assert p.n_open == len(plain) <= places


# --- Ogg


def plain_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


@given(st.binary(max_size=50))
@settings(deadline=None)
def test_page_checksum(data):
    assert ogg.page_crc(data) == plain_crc(data)


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_samples_round_trip(data):
    read = ogg.read_samples(ogg.write_samples(data))
    assert read["samples"] == data and read["whole"] and read["streams"] == 2 and read["duration"] == len(data) / ogg.RATE


@given(st.lists(st.integers(0, 70_000), max_size=6), st.lists(st.integers(0, 600), max_size=9))
@settings(max_examples=40, deadline=None)
def test_packets_over_pages_and_streams(a, b):
    streams = {}
    for serial, sizes in ((7, a), (9, b)):
        rng, end, packets = random.Random(serial), 0, []
        for n in [3, *sizes]:
            end += n
            packets.append((rng.randbytes(n), end))
        streams[serial] = packets
    found, counts = ogg.demux(ogg.mux([ogg.logical_pages(k, p) for k, p in streams.items()]))
    assert counts["bad_pages"] == counts["skipped_bytes"] == 0
    for k, p in streams.items():
        assert found[k].packets == [x for x, _ in p] and found[k].ended
        assert found[k].granules[-1] == p[-1][1]


def test_damage_is_found():
    whole = ogg.write_samples(bytes(range(256)) * 80)
    bad = bytearray(whole)
    bad[3000] ^= 1
    read = ogg.read_samples(bytes(bad))
    assert not read["whole"] and read["bad_pages"] == 1 and read["samples"] != bytes(range(256)) * 80
    assert ogg.read_samples(b"junk" + whole)["skipped_bytes"] == 4
    assert ogg.demux(None) == ({}, {"pages": 0, "bad_pages": 0, "skipped_bytes": 0})
    assert ogg.demux(whole[:40])[1]["bad_pages"] >= 1
    assert ogg.seconds(-1, 8000) is None


def test_padding():
    assert ogg.padded(b"") == bytes(64) and ogg.padded(b"x" * 64) == b"x" * 64 and len(ogg.padded(b"x" * 65)) == 128


# --- language ID


def test_profiles_are_the_plain_sums():
    e = langid.Encoder(dims=64)
    for t in ("Abc dé", "a", "  x1y  ", "日本語 text", "aaaa aaaa"):
        letters = [32]
        for c in t.lower():
            letters.append(ord(c) if c.isalpha() else 32)
        letters.append(32)
        letters = [c for i, c in enumerate(letters) if c != 32 or i == 0 or letters[i - 1] != 32]
        v = lambda cp: langid.letter_vector(cp, 64).astype(int)
        want = sum((np.roll(v(a), 2) * np.roll(v(b), 1) * v(c) for a, b, c in zip(letters, letters[1:], letters[2:])), np.zeros(64))
        assert np.array_equal(e([t.encode()])[0], want)
    assert not e([b"123 \n", b""]).any()


def test_profiles_with_a_small_cache(monkeypatch):
    texts = [bytes(random.Random(i).choices(b"abcdefghij ", k=400)) for i in range(6)]
    want = langid.Encoder(dims=32)(texts)
    monkeypatch.setattr(langid, "CACHE_GRAMS", 20)
    assert np.array_equal(langid.Encoder(dims=32)(texts), want)


# --- mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    got = mixing.targets([10, 100, 100], [5, 2, 1])
    assert got[0] == 30 and got == pytest.approx([30, 120, 60]) and sum(got) == pytest.approx(210)
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]


@given(st.lists(st.integers(1, 500), min_size=1, max_size=200), st.floats(0.05, 0.95), st.integers(0, 9))
@settings(max_examples=60, deadline=None)
def test_flight_keeps_totals(sizes, p, seed):
    size = np.array(sizes, float)
    before = np.full(len(size), p)
    after = mixing.flight(before, size, np.random.default_rng(seed))
    assert after.sum() == pytest.approx(before.sum()) and (after * size).sum() == pytest.approx((before * size).sum(), rel=1e-6, abs=1e-4)
    assert ((after > 0) & (after < 1)).sum() <= 2
    landed = mixing.landing(after, size, float((before * size).sum()))
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (before * size).sum()) <= size.max()


def test_flight_keeps_probabilities():
    size = np.array([3.0, 5, 8, 2, 9])
    runs = np.array([mixing.flight(np.full(5, 0.4), size, np.random.default_rng(s)) for s in range(4000)])
    assert np.allclose(runs.mean(0), 0.4, atol=0.03)


# --- sorted arrays


@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=60))
@settings(deadline=None)
def test_packed_arrays(keys):
    k = np.array(sorted(keys), np.uint64)
    c = np.arange(1, len(k) + 1)
    k2, c2 = arrays.unpack(arrays.pack(k, c))
    assert np.array_equal(k, k2) and np.array_equal(c, c2)


def test_arrays_written_and_mapped(tmp_path):
    uri = f"file://{tmp_path}/x/y"
    arrays.put(uri, {"a": np.arange(5, dtype=np.uint64), "none": np.empty(0, np.uint8), "b": np.array([1.5])})
    m = arrays.mapped(uri)
    assert m["a"].tolist() == [0, 1, 2, 3, 4] and len(m["none"]) == 0 and m["b"][0] == 1.5


# --- characters' model and base counts


def plain_counts(t):
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


@given(st.one_of(TEXTS, st.lists(st.sampled_from(["a", "b", "c\n", "d é"]), max_size=60).map(" ".join)))
@settings(max_examples=200, deadline=None)
def test_base_counts(t):
    assert quality_rules.base_counts(t.encode(), common.HashCache()) == plain_counts(t)


def test_character_model_sums_to_one_and_prefers_what_it_knows():
    text = b"the cat sat on the mat and the dog sat on the log " * 3
    grams = quality_rules.packed(quality_rules.class_codes(text))
    m = quality_rules.CharModel(*np.unique(grams, return_counts=True))
    for context in (grams[5], grams[9], np.uint64(7 << 12 | 9 << 6 | 3)):
        every = np.array([int(context) << 6 & (1 << 24) - 1 | c for c in range(quality_rules.CLASSES)], np.uint64)
        assert np.exp2(m.log2(every)).sum() == pytest.approx(1)
    mean = lambda t: m.log2(quality_rules.packed(quality_rules.class_codes(t))).mean()
    assert mean(b"the dog sat on the mat") > mean(b"xqz jjk pfw !! ##") + 1


def test_signs_and_upper_case_have_classes():
    assert len({quality_rules.class_codes(c)[0] for c in (b"#", b"$", b"|", b".", b"!", b"7", b"(", b"a")}) == 8
    assert quality_rules.class_codes(b"aB ").tolist() == [1, 29, 2, 0] and quality_rules.char_classes().max() < quality_rules.CLASSES <= 64


def test_discounts():
    assert language_model.modified_discounts([0, 0, 0, 0]) == (0.5, 0.5, 0.5)
    d = language_model.modified_discounts([100, 40, 20, 10])
    y = 100 / 180
    assert d == pytest.approx((1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.5))


# --- shingles


@given(TEXTS, TEXTS)
@settings(max_examples=100, deadline=None)
def test_shingles(a, b):
    def plain(t):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t)]
        return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} - {()}

    c = common.HashCache()
    x, y = (minhash.shingles(t.encode(), 2, c) for t in (a, b))
    assert len(x) == len(plain(a)) and len(np.intersect1d(x, y)) == len(plain(a) & plain(b))


def test_minima_of_blocks():
    m = minhash.Minima()
    s = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 3000, dtype=np.uint64))
    x = s >> np.uint64(32)
    want = np.array([((x * a + b) >> np.uint64(32)).min() for a, b in zip(m.a, m.b)])
    assert np.array_equal(m.signature(s), want) and len(m.keys(want)) == minhash.BANDS


# --- classifiers


def test_factorisation_is_all_pairs():
    rng = np.random.default_rng(1)
    model = {"w0": 0.3, "w": rng.normal(size=factorisation.BUCKETS + 3), "v": rng.normal(size=(factorisation.BUCKETS + 3, 4))}
    buckets, stats = [[3, 99], [7], []], rng.random((3, 3))
    row, col, value = factorisation.matrix(buckets, stats)
    z, _ = factorisation.logits(model, row, col, value, 3)
    for i in range(3):
        at = [(c, x) for r, c, x in zip(row, col, value) if r == i]
        want = model["w0"] + sum(model["w"][c] * x for c, x in at) + sum(model["v"][c] @ model["v"][d] * x * y for k, (c, x) in enumerate(at) for d, y in at[k + 1 :])
        assert z[i] == pytest.approx(want)


def test_statistics_are_shares():
    for t in (b"", b" ", b"A B! ## | x\n\nx\nx", "é漢".encode() * 500, b"word " * 5000):
        s = factorisation.statistics(t)
        assert len(s) == len(factorisation.STATS) and all(0 <= x <= 1 for x in s)


def _biased(n=300, seed=0):
    """Texts of which 'vile' is toxic, and where one group is named in toxic texts more often."""
    rng = random.Random(seed)
    rows, y = [], []
    for _ in range(n):
        words = rng.choices([f"w{i}" for i in range(60)], k=20)
        bad = rng.random() < 0.4
        if bad and rng.random() < 0.9:
            words.append("vile")
        if rng.random() < (0.9 if bad else 0.1):
            words.append("muslim")
        elif rng.random() < 0.5:
            words.append("christian")
        rows.append(" ".join(words).encode())
        y.append(float(bad))
    return rows, np.array(y)


def test_counterfactual_penalty_frees_neutral_mentions():
    texts, y = _biased()
    rows = [toxicity.sampled(t) for t in texts]
    move = {}
    for penalty in (0.0, 5.0):
        s = toxicity.scorer(toxicity.fit(rows, y, penalty=penalty))()
        named, other, vile = s([b"w1 w2 w3 muslim", b"w1 w2 w3 christian", b"w1 w2 vile"])
        move[penalty] = abs(named - other)
        assert vile > 0.5
    assert move[5.0] < 0.3 * move[0.0]


def test_affixes_of_seven_bytes_count():
    known = set(toxicity.extract(b"unpleasantly").tolist())
    assert {toxicity.word_id(b"^unpleas"), toxicity.word_id(b"santly$"), toxicity.word_id(b"asantly$")} <= known and toxicity.SAMPLE_ROWS >= 4096


def test_counterfactuals_in_four_languages():
    for text in ("the women here", "die Männer hier", "MÄNNER", "schwarzen", "les Étrangers", "une femme musulmane", "las mujeres", "Árabes", "judíos"):
        words = toxicity.words_of(text.encode())
        others = toxicity.counterfactual_words(text.encode())
        assert len(others) == toxicity.SWAPS and all(o != words and len(o) <= len(words) for o in others), text
    assert all(o & {t.encode() for t in ("immigrés", "réfugiés", "indigènes")} and b"w1" in o for o in toxicity.counterfactual_words("w1 étrangers".encode()))


def test_texts_without_a_term_get_a_neutral_mention():
    terms = {t.encode() for kind in toxicity.IDENTITY_TERMS for t in kind}
    for text in (b"", b"w1 w2 w3", b"w1 w2 w4"):
        others = toxicity.counterfactual_words(text)
        assert len(others) == toxicity.SWAPS and all(len(o - toxicity.words_of(text)) == 1 and o - toxicity.words_of(text) <= terms for o in others)
    features, changes = toxicity.unpacked(toxicity.sampled(b"w1 w2 w3"))
    assert features.tolist() == toxicity.extract(b"w1 w2 w3").tolist() and len(changes) == toxicity.SWAPS and all(len(g) and not len(r) for g, r in changes)


@given(st.lists(st.sampled_from("muslim christian frau frauen mann noire blanche vile viler villain women womanly".split()), max_size=8))
@settings(max_examples=100, deadline=None)
def test_counterfactual_changes_are_those_of_the_swapped_text(words):
    text = " ".join(words).encode()
    mine = set(toxicity.extract(text).tolist())
    for (gained, lost), other in zip(toxicity.counterfactuals(text), toxicity.counterfactual_words(text), strict=True):
        want = set(toxicity.extract(b" ".join(other)).tolist())
        assert set(gained.tolist()) == want - mine and set(lost.tolist()) == mine - want


def test_toxicity_scores_agree_with_features():
    texts, y = _biased(seed=2)
    rows = [toxicity.sampled(t) for t in texts]
    m = toxicity.fit(rows, y)
    weights = dict(zip(m["ids"].tolist(), m["weights"].tolist()))
    got = toxicity.scorer(m)()(texts[:20] + [b"", b"VILE!!! vile, Vile"])
    for t, s in zip(texts[:20] + [b"", b"VILE!!! vile, Vile"], got):
        z = m["bias"] + sum(weights.get(i, 0) for i in toxicity.extract(t).tolist())
        assert s == pytest.approx(1 / (1 + math.exp(-z)))
    assert toxicity.scorer(toxicity.fit([], np.empty(0)))()([b"x"])[0] == 0


def test_copies_count_once():
    a, b = np.arange(50, dtype=np.int64) * 7919, np.arange(50, dtype=np.int64) * 104729 + 5
    rows, y = without_copies([a, np.append(a[:-2], 10**9), b, np.empty(0, np.int64)], np.array([1.0, 0, 1, 0]))
    assert len(rows) == 3 and sorted(y) == [0, 0.5, 1]


def test_licences():
    s = licences.Scanner(licences.model())
    for line, family in (
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.", "mit"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("LICENSED UNDER CC BY-SA 4.0", "cc-by-sa"), ("Licensed under the GNU Lesser General Public License, version 2.1", "lgpl"),
    ):
        n, found = s(f"First line of words.\n\n{line}\nlast".encode())
        assert n == 3 and [(m["line"], m["family"]) for m in found] == [(2, family)], line
        assert f"First line of words.\n\n{line}\nlast"[found[0]["start"] : found[0]["end"]] == line
    for line in ("The driving licence was granted under the law of the state.", "Released in the spring under the bridge.", "version 2.0 of the general public report", "", "\n \n"):
        assert s(line.encode())[1] == []
    assert licences.model()["temperature"] > 0


#: Wordings that are no template.
HELD_OUT = {
    "apache-2.0": ["Code in this folder is made available under the Apache License 2.0", "Source files here are covered by the Apache License, Version 2.0 unless noted otherwise"],
    "mit": ["Copyright 2021 the authors, MIT License", "Everything below is free software under the MIT License, see the file COPYING"],
    "bsd": ["Contributions are accepted under the BSD 3-Clause License only", "Files are covered by the BSD 2-Clause License"],
    "gpl": ["It is free software, covered by the GNU General Public License, version 2, with one exception", "The tool is GNU General Public License v3.0 software"],
    "lgpl": ["Linking is permitted by the GNU Lesser General Public License v3.0 of the library"],
    "agpl": ["The server falls under the GNU Affero General Public License v3.0 as well"],
    "mpl-2.0": ["Files in this tree use the Mozilla Public License 2.0 instead"],
    "cc-by": ["All figures are available for reuse under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Text and tables may be reused under the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Photographs by the author, Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd": ["The report is published with a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc0": ["We dedicate the tables to the public, CC0 1.0 Universal license applies"],
    "isc": ["Small helpers are under the ISC License"],
    "unlicense": ["This is free and unencumbered software released into the public domain, says the header"],
}
NO_LICENCES = [
    "The general public was asked for a licence to print version 3 of the book.", "You should have received a copy of the letter along with the parcel.", "He released the birds under the open sky.", "The terms of the lease are distributed among the heirs under the law.", "Redistribution of land in the valley is permitted provided that conditions are met by the farmers.",
]


def test_licences_in_wordings_that_are_no_template():
    scanner = licences.Scanner(licences.model())
    templates = {t for ts in licences.TEMPLATES.values() for t in ts}
    found = [[m["family"] for m in scanner(t.encode())[1]] == [f] for f, ts in HELD_OUT.items() for t in ts]
    assert not templates & {t for ts in HELD_OUT.values() for t in ts} and len(found) == 18 and sum(found) >= 15
    assert all(scanner(t.encode())[1] == [] for t in NO_LICENCES)


def test_licence_templates_alone():
    s = licences.Scanner(licences.model())
    for family, templates in licences.TEMPLATES.items():
        for t in templates:
            assert [m["family"] for m in s(f"Words before.\n{t}\nafter".encode())[1]] == [family], t
            pairs = {(a, b) for w in [licences.words_of(t.encode())] for a, b in zip(w, w[1:])}
            dull = sum(a in licences._STOP and b in licences._STOP for a, b in pairs)
            assert dull < licences.MIN_TEMPLATE * len(pairs)  # no template is found without a telling pair


def test_licences_of_one_line():
    s = licences.Scanner(licences.model())
    far = " " + "lorem ipsum dolor sit amet " * 60
    notices = {"mit": "Released under the MIT License", "apache-2.0": "Licensed under the Apache License, Version 2.0", "cc-by-nc": "Licensed under CC BY-NC 4.0", "gpl": "SPDX-License-Identifier: GPL-3.0-or-later"}
    for between in (far, " lorem ipsum dolor. ", ". "):
        text = "Lorem" + between + between.join(notices.values()) + between + notices["mit"] + between + "end"
        n, found = s(text.encode())
        assert n == 1 and [m["family"] for m in found] == [*notices, "mit"], between
        assert [text[m["start"] : m["end"]] for m in found] == [*notices.values(), notices["mit"]]
    # a notice that stands at any place of the windows is one match
    for before in range(0, 200, 7):
        for family, t in (("agpl", licences.TEMPLATES["agpl"][0]), ("mit", licences.TEMPLATES["mit"][2]), ("lgpl", licences.TEMPLATES["lgpl"][0])):
            text = "word " * before + t + " word" * 150
            assert [m["family"] for m in s(text.encode())[1]] == [family], (before, family)
    agpl = licences.TEMPLATES["agpl"][0] + ", either version 3 of the License, or (at your option) any later version."
    assert [m["family"] for m in s(("word " * 50 + agpl + " word" * 90).encode())[1]] == ["agpl"]
    assert [m["family"] for m in s(b"Dual licensed under the MIT License and the Apache License, Version 2.0.")[1]] == ["mit", "apache-2.0"]


def test_fold_is_crc32():
    assert common.crc(b"7") == zlib.crc32(b"7") and struct.calcsize("<I") == 4
