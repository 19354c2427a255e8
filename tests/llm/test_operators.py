"""Operators against brute force, the libraries themselves, and exact round trips."""

import hashlib
import itertools
import math
import random
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from atomweave.llm import common, encoding, exact_dedup, language_id, media, packing, paragraphs, pieces, quality, simhash, token_counts, token_files, webp, webp_text
from atomweave.llm import words as words_
from atomweave.llm.queries import tokenizer

BYTE, WORD, PIECE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h int, digest string"
ODD = ["", " ", "a", "<|endoftext|> x<|endoftext|>", "日本語 テキスト", "a\x1cb\x85c", "I'm  you'll   x\n\n y", "😀😀 aaaa", "İstanbul ŁÓDŹ ß", "aaaaaaa aaaa", "\t\n", "x" * 400]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1, "clash") for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True)], SCHEMA)


def noise(seed, n=60, alphabet="ab '\n\tsSé1.!<|>İ日 ́"):
    rnd = random.Random(seed)
    return "".join(rnd.choice(alphabet) for _ in range(n))


ALL = [*ODD, *(noise(s) for s in range(40)), None, "word " * 3000, *ODD[:3]]
IDS = [*range(len(ALL) - 2), None, 5]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_encoder_gives_the_library_s_ids(name):
    e = encoding.Encoder(tokenizer(name))
    assert e.kind != "other"
    for t, ids in zip(ALL, e.ids(ALL), strict=True):
        assert ids.tolist() == e.tok.encode(t or "", add_special_tokens=False).ids


def test_token_counts(spark):
    tok = encoding.Encoder(tokenizer(BYTE)).tok
    got = token_counts.token_counts(docs(spark, ALL, IDS), tokenizer(BYTE)).collect()
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in zip(IDS, ALL, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.token_counts(docs(spark, []), tokenizer(BYTE)).count() == 0


def test_pieces_equal_the_library():
    e = pieces.PieceEncoder(tokenizer(PIECE))
    texts = [*(t for t in ALL if t), *(noise(s, 80, "ab  tehinorS\né1.日-=") for s in range(200))]
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == e.model.sp.encode(t) and e.decode(ids) == t


def test_piece_queries(spark):
    rows = pieces.piece_ids(docs(spark, ALL, IDS), tokenizer(PIECE))
    assert rows.count() == len(ALL) and rows.where("not decoded_same").count() == 0
    back = {r.doc_id: r.text for r in pieces.piece_texts(rows.where("doc_id < 12 and doc_id <> 5"), tokenizer(PIECE)).collect()}
    assert all(back[i] == ALL[i] for i in back)


def test_webp_round_trips():
    rng = np.random.default_rng(0)
    smooth = (np.add.outer(np.arange(37), np.arange(53))[..., None] * np.array([1, 2, 3, 0]) + np.array([0, 7, 9, 255])).astype(np.uint8)
    few = rng.integers(0, 3, (20, 33, 4)).astype(np.uint8)
    P, full = webp.Plan, rng.integers(0, 256, (9, 13, 4)).astype(np.uint8)
    cases = [(full, P()), (few, P(references=True)), (few, P(cache_bits=5)), (few, P(references=True, cache_bits=3, group_block=3))]
    cases += [(smooth, P(references=True, cache_bits=4, steps=[(webp.PREDICTOR, [11, 12, 13, 5, 10], 2), (webp.CROSS_COLOUR, [0xFF102030, 0xFFE0F1A5], 3), (webp.SUBTRACT_GREEN, 0, 0)]))]
    cases += [(full, P(steps=[(webp.PREDICTOR, [m], 2)])) for m in range(14)]
    for n in (1, 2, 4, 16, 200):
        cases.append((rng.integers(0, 256, (n, 4)).astype(np.uint8)[rng.integers(0, n, (11, 29))], P(references=True, steps=[(webp.PALETTE, 0, 0)])))
    for pixels, plan in cases:
        assert (webp.decode(webp.encode(pixels, plan)) == pixels).all()
    assert (webp.decode(webp.encode_literal(full)) == full).all()
    assert len(webp.NEAR) == 120 and webp.NEAR[-1] == (8, 7)
    with pytest.raises(ValueError):
        webp.decode(b"RIFF")


def test_many_files_are_read_in_lockstep(monkeypatch):
    rng = np.random.default_rng(4)
    text = lambda n: np.frombuffer((" ".join(rng.choice(["the", "quick", "brown", "fox", "Über", "über", "42", "-- "], n)) + " " * 192).encode()[: 192 * max(1, n // 40)], np.uint8)
    pictures = [text(int(n)).reshape(-1, 48, 4) for n in rng.integers(40, 3000, 70)]
    pictures += [rng.integers(0, 256, (5, 48, 4)).astype(np.uint8), np.full((30, 48, 4), 32, np.uint8), text(4000).reshape(-1, 48, 4)[:36].reshape(12, 144, 4)]
    pictures += [np.tile(rng.integers(0, 256, (1, 7, 4)).astype(np.uint8), (400, 9, 1))]
    files = webp_text.encode_many(pictures)
    assert sum(map(len, files[:70])) < 0.7 * sum(x.size for x in pictures[:70])
    for x, f in zip(pictures, files, strict=True):
        assert (webp.decode(f) == x).all() and webp_text.encode_many([x]) == [f]
    kinds = {webp_text._plain(webp.stream_of(f))[1].cache for f in files}
    assert len(kinds) > 1
    few = rng.integers(0, 3, (20, 33, 4)).astype(np.uint8)
    others = [webp.encode(few, webp.Plan(references=True, cache_bits=3, group_block=3)), webp.encode(few, webp.Plan(references=True, cache_bits=5)), webp.encode(few, webp.Plan(steps=[(webp.SUBTRACT_GREEN, 0, 0)]))]
    for fewest in (1, 8, 1000):
        monkeypatch.setattr(webp_text, "FEWEST", fewest)
        got = webp_text.decode_many(files + others)
        assert all((a == b).all() for a, b in zip(got, [*pictures, few, few, few], strict=True))
    for cut in (files[0][:-40], files[0][:60]):
        with pytest.raises(ValueError):
            webp_text.decode_many([cut])


def test_webp_files_made_by_hand():
    # 2 x 1 pixels, no transform, cache or groups; green, red, blue codes of one symbol each, alpha 255, distance 0:
    # signature, sizes less one, alpha used, version, then per code: simple, one symbol, eight bits wide, the symbol
    bits = [(0x2F, 8), (1, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    for symbol in (7, 200, 31, 255):
        bits += [(1, 1), (0, 1), (1, 1), (symbol, 8)]
    bits += [(1, 1), (0, 1), (0, 1), (0, 1)]
    n = at = 0
    for v, size in bits:
        n, at = n | v << at, at + size
    stream = n.to_bytes((at + 7) // 8, "little")
    chunk = lambda name, x: name + len(x).to_bytes(4, "little") + x + bytes(len(x) & 1)
    plain = b"WEBP" + chunk(b"VP8L", stream)
    extended = b"WEBP" + chunk(b"VP8X", bytes([16, 0, 0, 0, 1, 0, 0, 0, 0, 0])) + chunk(b"EXIF", b"abc") + chunk(b"VP8L", stream)
    for body in (plain, extended):
        data = b"RIFF" + len(body).to_bytes(4, "little") + body
        assert webp.decode(data).tolist() == [[[200, 7, 31, 255]] * 2] and webp_text.decode_many([data])[0].tolist() == [[[200, 7, 31, 255]] * 2]


def test_media(spark):
    for r in media.text_media(docs(spark, ALL, range(len(ALL))), keep_media=True).collect():
        data = (ALL[r.doc_id] or "").encode()
        want = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and webp.decode(bytes(r.media)).tobytes()[: len(want)] == want
    t = spark.createDataFrame([(1, None), (2, b"no")], "doc_id long, media binary")
    assert [r.pixels for r in media.media_arrays(t).collect()] == [None, None]


def test_packing_plan():
    for seed in range(40):
        rnd = random.Random(seed)
        cap = rnd.choice([10, 100, 4096])
        items = [max(1, int(rnd.choice([rnd.random(), rnd.random() ** 3]) * cap)) for _ in range(rnd.choice([1, 5, 400]))]
        counts = {n: items.count(n) for n in items}
        bins, left, rooms = packing.plan(counts, cap), dict(counts), []
        for n, what in bins:
            assert sum(a * b for a, b in what) <= cap and sum(b for a, b in what if a * 3 > cap) <= 2
            for a, b in what:
                left[a] -= n * b
        assert not any(left.values())
        for x in sorted(items, reverse=True):  # plain best fit
            fit = [r for r in rooms if r >= x]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else cap) - x)
        assert sum(n for n, _ in bins) <= len(rooms)


def test_pack(spark):
    tok = encoding.Encoder(tokenizer(WORD)).tok
    rows = packing.pack(docs(spark, ALL, range(len(ALL))), tokenizer(WORD), capacity=64).collect()
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(ALL):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            cut = ids[k * 64 : k * 64 + 64]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, k * 64, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))
        assert sum(r.length for r in by[i]) == len(ids)
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs(spark, []), tokenizer(WORD)).count() == 0


def test_token_files(spark):
    tok = encoding.Encoder(tokenizer(BYTE)).tok
    ids = [None if i == 3 else i for i in range(len(ALL))]
    got = {r.doc_id: r for r in token_files.token_files(docs(spark, ALL, ids), tokenizer(BYTE)).collect()}
    at = 0
    for i in [None, *(i for i in ids if i is not None)]:
        x = [*tok.encode(ALL[3 if i is None else i] or "", add_special_tokens=False).ids, 2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    assert token_files.token_files(docs(spark, []), tokenizer(BYTE)).count() == 0


def test_covering_masks_miss_no_pair():
    rnd = random.Random(1)
    for radius in (1, 3, 5):
        m = simhash.masks(radius, list(range(64)))
        assert len(m) == 2 ** (radius + 1) - 1
        for _ in range(500):
            d = sum(1 << b for b in rnd.sample(range(64), radius))
            assert any(not x & d for x in m)


def test_simhash_components(spark):
    base = noise(1, 900, "abcdefgh   ")
    texts = [base, base + " tail", base + " other end", *ODD, None, *(noise(s, 200, "abcdefgh  ") for s in range(60)), base]
    fp = []
    for t in texts:
        words = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fp.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > len(hs)))
    comp = list(range(len(texts)))
    for _ in comp:
        for i in range(len(texts)):
            comp[i] = min(comp[j] for j in range(len(texts)) if (fp[i] ^ fp[j]).bit_count() <= 3)
    got = {r.id: r for r in simhash.simhash_components(docs(spark, texts)).collect()}
    assert [got[i].fp & (2**64 - 1) for i in range(len(texts))] == fp
    assert [got[i].component for i in range(len(texts))] == comp
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_large_buckets_are_dealt_again(spark, monkeypatch):
    rnd = random.Random(2)
    centre = rnd.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)})
    signed = [simhash._signed(x) for x in fps]
    want = list(range(len(fps)))
    for _ in range(20):
        want = [min(want[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
    monkeypatch.setattr(simhash, "LARGE", 8)
    got = {r.node: r.component for r in common.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3)).collect()}
    groups = lambda lab: sorted(sorted(i for i in range(len(fps)) if lab[i] == k) for k in set(lab))
    assert groups(want) == groups([got.get(s, s) for s in signed])


def test_majority_fingerprints():
    h = np.random.default_rng(0).integers(0, 2**64, (3000, 2), dtype=np.uint64)
    begins = [0, 1, 3, 700, 1210, 1211, 2999]
    got = words_.majority(h, np.array(begins))
    for g, (i, j) in enumerate(zip(begins, [*begins[1:], 3000], strict=True)):
        for c in range(2):
            assert int(got[g, c]) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[i:j, c]) > j - i)


def test_forest_joins_what_near_pairs_join():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, (6, 4), dtype=np.uint64)
    x = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, (12, 4), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (12, 4), dtype=np.uint64)) for b in base])
    bits = np.bitwise_count(x[:, None] ^ x[None]).sum(-1)
    for limit in (3, 9, 12, 200):
        of = np.arange(len(x)) // 2
        want, got = of.copy(), of.copy()
        for lab, pairs in ((want, np.argwhere(bits <= limit).tolist()), (got, simhash.forest(of, x, limit))):
            for _ in range(len(x)):
                for a, b in pairs:
                    lab[(lab == lab[a]) | (lab == lab[b])] = min(lab[a], lab[b])
                    assert bits[a, b] <= limit
                if lab is got:
                    break
        assert got.tolist() == want.tolist()


def test_failed_pairs_of_a_large_bucket_have_replacements(spark, monkeypatch):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base[:i] + ["other"] + base[i + 1 :]) for i in range(5, 245, 20)]
    monkeypatch.setattr(simhash, "_pairs", lambda nodes, of, sketch, limit: (nodes[:0], nodes[:0]))  # as if all of the forest had failed
    assert sorted(r.id for r in simhash.near_duplicates(docs(spark, texts)).collect()) == list(range(1, len(texts)))


@pytest.mark.parametrize(("large", "again", "grams"), [(512, 31, 1 << 18), (6, 31, 400), (6, 1, 400)])
def test_a_text_in_many_buckets_is_compared_as_one_row(spark, monkeypatch, large, again, grams):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    texts = []
    for edits in [1] * 20 + [2] * 10 + [3] * 10:
        v = list(base)
        for i in rnd.sample(range(10, 110), edits):
            v[i] = f"w{rnd.randrange(10**6)}"
        texts.append(" ".join(v))
    sets = [words_.shingle_set(t, 5) for t in texts]
    want = list(range(len(texts)))
    for _ in want:
        for i, j in itertools.combinations(want, 2):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                want[i] = want[j] = min(want[i], want[j])
    made, staged = {}, simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, name: made.update({name: staged(df, name)}) or made[name])
    for name, value in (("LARGE", large), ("AGAIN", again), ("GRAMS", grams)):
        monkeypatch.setattr(simhash, name, value, raising=False)
    monkeypatch.setattr(simhash, "_pairs", lambda nodes, of, sketch, limit: (nodes[:0], nodes[:0]))  # all that the forest could find is left
    got = {r.id: r.keep_id for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert {i: k for i, k in enumerate(want) if i != k} == got and 15 < len(got) < 35
    assert made["near-large"].count() == len(texts) == made["near-large"].select("node").distinct().count()


def test_similar_members_equal_plain_sets():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 9000, (4, 60))
    sets = [np.unique(np.where(rng.random(60) < 0.07, rng.integers(0, 9000, 60), base[i % 4])) for i in range(40)]
    plain = [set(x.tolist()) for x in sets]
    of = np.arange(40) // 2
    want, got = of.copy(), of.copy()
    near = [(i, j) for i in range(40) for j in range(i) if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j])]
    found = simhash.similar_members(of, sets, 0.8)
    for lab, pairs in ((want, near), (got, found)):
        for _ in range(40):
            for a, b in pairs:
                lab[(lab == lab[a]) | (lab == lab[b])] = min(lab[a], lab[b])
    assert got.tolist() == want.tolist() and len(set(want.tolist())) < 15 and len(found) < 40
    assert all(tuple(sorted(p)[::-1]) in near for p in found)


@pytest.mark.parametrize("large", [6, 512])
def test_near_duplicates_against_brute_force(spark, monkeypatch, large):
    rnd = random.Random(4)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").orderBy("doc_id").limit(260).collect()]
    other = " ".join(texts).split()

    def edited(words, least):
        v, grams = list(words), words_.shingle_set(" ".join(words), 5)
        while True:
            u = list(v)
            at = rnd.randrange(len(u))
            u[at : at + rnd.randrange(2)] = [rnd.choice(other)]
            g = words_.shingle_set(" ".join(u), 5)
            if len(g & grams) < least * len(g | grams):
                return " ".join(v)
            v = u

    long_ = [t.split() for t in texts if 30 <= len(t.split()) < 400]
    texts += [edited(w, least) for w in long_[:70] for least in (0.8, 0.62)] + [edited(long_[80], 0.85) for _ in range(25)] + [None, "", " \n", "x", "X "]
    sets = [words_.shingle_set(t, 5) if t and t.split() else frozenset() for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = list(range(len(sets)))
    for _ in range(12):
        for i, j in near:
            want[i] = want[j] = min(want[i], want[j])
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "SMALL", min(large, simhash.SMALL))
    gone = {r.id: r.keep_id for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    due = {i for i, k in enumerate(want) if i != k}
    assert len(due) > 80 and len(due & set(gone)) >= 0.95 * len(due)
    assert all(want[i] == want[k] for i, k in gone.items())  # nothing goes without a chain of similar texts


@pytest.mark.parametrize("digest", [exact_dedup.sha256_of, lambda n: F.substring(exact_dedup.sha256_of(n), 1, 1)])
def test_exact_dedup(spark, digest):
    texts = ["a b", "ab", None, "", " \t", "a  b", "c", "c", "d ", "d"]
    got = {r.id: r for r in exact_dedup.StreamingExactDedup(spark, digest=digest).add(docs(spark, texts)).collect()}
    norm = ["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r") for t in texts]
    for i, n in enumerate(norm):
        own = [j for j in range(len(texts)) if norm[j] == n]
        keep = min(own, key=lambda j: (-len(texts[j] or ""), j))
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(own), i == keep)


def test_exact_dedup_goes_on(spark):
    state = exact_dedup.StreamingExactDedup(spark)
    state.add(docs(spark, ["x", "y"], [3, 4])).collect()
    rows = state.add(docs(spark, ["x", "x  x", "z"], [1, 2, 9])).collect()
    assert {r.id: (r.keep_id, r.group_size) for r in rows} == {1: (1, 2), 2: (2, 1), 9: (9, 1)}
    again = exact_dedup.StreamingExactDedup(spark, state.root).add(docs(spark, [" y ", "z"], [5, 10])).collect()
    assert {r.id: (r.keep_id, r.group_size, r.kept) for r in again} == {5: (5, 2, True), 10: (9, 2, False)}
    same = exact_dedup.keep_one(docs(spark, ["q", "q", "r", "q "], [1, 1, None, 2])).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in same))) == ["(2, 'q ')", "(None, 'r')"]
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0 and exact_dedup.keep_one(docs(spark, [])).count() == 0


def test_exact_dedup_compares_bytes_with_earlier_batches(spark):
    state = exact_dedup.StreamingExactDedup(spark, digest=lambda n: F.lit("the same for all"))
    add = lambda texts, ids: {r.id: (r.keep_id, r.group_size, r.kept) for r in state.add(docs(spark, texts, ids)).collect()}
    assert add(["alpha"], [1]) == {1: (1, 1, True)}
    assert add(["beta"], [2]) == {2: (2, 1, True)}
    assert add(["alpha", "beta ", "gamma"], [3, 4, 5]) == {3: (1, 2, False), 4: (4, 2, True), 5: (5, 1, True)}
    assert add(["alpha"], [6]) == {6: (1, 3, False)}


@pytest.mark.parametrize("step", ["_consume", "_note", "_differing"])
def test_an_exact_dedup_batch_that_failed_counts_once(spark, monkeypatch, step):
    rows = docs(spark, ["x", "x ", "y"], [1, 2, 3])
    first = exact_dedup.StreamingExactDedup(spark)
    first.add(docs(spark, ["y"], [9])).collect()
    with monkeypatch.context() as m:
        real, calls = getattr(exact_dedup.StreamingExactDedup, step), []

        def fails(self, *args):  # the note of arrival is written, that of the end isn't
            calls.append(args)
            if step == "_note" and len(calls) == 1:
                return real(self, *args)
            raise RuntimeError("lost")

        m.setattr(exact_dedup.StreamingExactDedup, step, fails)
        with pytest.raises(RuntimeError):
            first.add(rows, name="second")
    again = exact_dedup.StreamingExactDedup(spark, first.root)
    if step != "_differing":  # else the stream is through with it
        with pytest.raises(ValueError):
            again.add(docs(spark, ["other"], [7]))
    want = {1: (2, 2, False), 2: (2, 2, True), 3: (3, 2, True)}  # the last "y" has the smaller id
    got = lambda: {r.id: (r.keep_id, r.group_size, r.kept) for r in again.add(rows, name="second").collect()}
    assert got() == want and got() == want
    with pytest.raises(ValueError):
        again.add(docs(spark, ["other"], [7]), name="second")


def test_exact_dedup_compacts_its_state(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COMPACT", 1)
    state = exact_dedup.StreamingExactDedup(spark)
    for n in range(4):
        rows = state.add(docs(spark, ["x", f"own {n}"], [n, 10 + n])).collect()
        assert {r.id: (r.keep_id, r.group_size) for r in rows} == {n: (0, n + 1), 10 + n: (10 + n, 1)}
    assert len(common.listed(spark, f"{state.root}/state-out")) <= 2


def test_substring_dedup(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(70)]
    texts = [" ".join([*(word() for _ in range(60)), *passage, *(word() for _ in range(50))]) for _ in range(6)] + [" ".join(word() for _ in range(200)), None, "", "short"]
    rows = {r.doc_id: r for r in paragraphs.substring_dedup(docs(spark, texts)).collect()}
    assert rows[0].n_removed == 0 and all(rows[i].n_removed == 0 for i in (6, 7, 8, 9))
    text = " ".join(passage)
    for i in range(1, 6):
        assert rows[i].words_removed >= 30 and set(rows[i].first_docs) == {0}
        for s in rows[i].spans:
            gone = texts[i][s.start : s.stop].split()
            assert sum(w in passage for w in gone) >= 0.8 * len(gone)  # paragraphs count as repeated from a similarity of 0.8 on
    cut = {r.doc_id: r.text for r in paragraphs.remove_repeats(docs(spark, texts)).collect()}
    assert cut[0] == texts[0] and all(text not in cut[i] for i in range(1, 6)) and cut[7] is None
    assert paragraphs.substring_dedup(docs(spark, [])).count() == 0
    assert paragraphs.tune(0.8, 0.95) == (3, 2)


@pytest.mark.parametrize("limit", [256, 8])
def test_all_similar_paragraphs_of_a_bucket_are_linked(spark, monkeypatch, limit):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(20):  # all of one bucket share their last words; few are similar
        base = [word() for _ in range(20)]
        texts += [[*base, "the", "last", "five", "words", "here"], [*([word()] * n + base[n:] for n in (1, 2, 5)), []][rnd.randrange(3)] + ["the", "last", "five", "words", "here"]]
    texts += [["same", str(n), "q", *texts[0][3:]] for n in range(40)]  # a group in which all share most
    texts = sorted({" ".join(t) for t in texts})
    sets = [paragraphs.shingles(t) for t in texts]
    want = list(range(len(sets)))
    for _ in range(8):
        want = [min(want[j] for j in range(len(sets)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(len(sets))]
    monkeypatch.setattr(paragraphs, "LIMIT", limit)
    members = spark.createDataFrame([(7, n, -n, t) for n, t in enumerate(texts)], "b long, k1 long, k2 long, sh string")
    links = [(r.a1, r.b1) for r in paragraphs._bucket_links(members, 0.8).collect()]
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in links)
    got = list(range(len(sets)))
    for _ in got:
        for a, b in links:
            got[a] = got[b] = min(got[a], got[b])
    assert got == want and 10 < len(set(want)) < len(sets) - 20


def test_paragraphs_are_those_of_a_plain_cutter():
    rnd = random.Random(3)
    texts = [" \n".join(rnd.choice(["aa", "b", "Cé", "dd", "x1"]) + rnd.choice(["", "", "k", "é"]) for _ in range(n)) for n in (1, 4, 5, 7, 25, 26, 40, 200)] + ["", " ", "tick " * 60]
    c = paragraphs.Cutter(6, 3, 2)
    got = c.table([t.encode() for t in texts])
    mixed = lambda x, k: (lambda y: y ^ y >> 29)((x ^ x >> 31) * int(words_.MIX[k]) % 2**64)
    rows = []
    for t, text in enumerate(texts):
        words = words_.words_of(text)
        m = [mixed(sum((b + 1) * pow(words_.BASE, k, 2**64) for k, b in enumerate(w)) % 2**64, 0) for w in words]  # noqa: B023
        g = [mixed((m[i] + m[i + 1] * int(words_.MIX[1]) + m[i + 2] * int(words_.MIX[2])) % 2**64, 3) for i in range(len(m) - 2)]
        cut = {min(range(i, i + 6), key=lambda j: (g[j] >> 32, j)) for i in range(len(g) - 5)}  # noqa: B023
        cut = sorted({p for p in cut if not p or g[p] != g[p - 1]} | {0}) if words else []
        places = list(words_.WORD.finditer(text))
        for a, b in zip(cut, [*cut[1:], len(words)][: len(cut)], strict=True):
            e = min(max(b, a + 8), len(words))
            rows.append((t, a, places[a].start(), places[b - 1].end(), b - a, text[places[a].start() : places[e - 1].end()].encode()))
    assert list(zip(*(list(got[n]) for n in ("text", "pos", "start", "stop", "words", "sh")), strict=True)) == rows
    alone = [c.table([t.encode()]) for t in texts if t.strip()]
    assert np.concatenate([x["b2"] for x in alone]).tolist() == got["b2"].tolist() and np.concatenate([x["k1"] for x in alone]).tolist() == got["k1"].tolist()


def test_removed_spans_are_the_common_runs_of_brute_force(spark):
    """All words of runs of 50 words or more that an earlier text has go; other words only in similar paragraphs at their ends."""
    rnd = random.Random(29)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    passages = [[word() for _ in range(rnd.randint(50, 95))] for _ in range(25)]
    texts = []
    for _ in range(70):
        t = [word() for _ in range(rnd.randint(0, 40))]
        for p in rnd.sample(passages, rnd.randint(0, 3)):
            t += p + [word() for _ in range(rnd.randint(0, 40))]
        texts.append(t)
    rows = {r.doc_id: r for r in paragraphs.substring_dedup(docs(spark, [" ".join(t) for t in texts])).collect()}
    seen: dict = {}
    for n, t in enumerate(texts):
        must, may = set(), set()
        for i in range(len(t)):
            for m, j in seen.get(t[i], ()):
                k = 0
                while i + k < len(t) and j + k < len(texts[m]) and t[i + k] == texts[m][j + k]:
                    k += 1
                must |= set(range(i, i + k)) if k >= 50 else set()
                may |= set(range(i, i + k)) if k >= 13 else set()
        for i, w in enumerate(t):
            seen.setdefault(w, []).append((n, i))
        starts = {x: i for i, x in enumerate(np.cumsum([0] + [len(w) + 1 for w in t])[:-1].tolist())}
        gone = {i for s in rows[n].spans or [] for x, i in starts.items() if s.start <= x < s.stop}
        assert must <= gone and all(must & set(range(i - 6, i + 7)) for i in gone - must - may), n


def test_passages_of_just_over_50_words_go_whole(spark):
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    fill = lambda: [word() for _ in range(rnd.randint(5, 60))]
    passages = [[word() for _ in range(51 + n % 10)] for n in range(60)]
    texts = [[*fill(), *p, *fill()] for p in passages] + [[*fill(), *p, *fill()] for p in passages]
    common_ = [word() for _ in range(20)]  # part of two passages, and in the first text of all
    mixed = [word() for _ in range(18)] + common_ + [word() for _ in range(18)]
    texts = [fill() + common_ + fill(), *texts, [*fill(), *mixed, *fill()], [*fill(), *mixed, *fill()], ["tick"] * 120]  # a word over and over is one paragraph
    rows = {r.doc_id: r for r in paragraphs.substring_dedup(docs(spark, [" ".join(t) for t in texts])).collect()}
    n = len(passages)
    gone = lambda i: " ".join(" ".join(texts[i])[s.start : s.stop] for s in rows[i].spans or [])
    assert all(rows[i].n_removed == 0 for i in range(n + 1))
    for i, p in enumerate(passages):
        assert " ".join(p) in gone(n + 1 + i) and rows[n + 1 + i].first_docs == [1 + i]
        assert rows[n + 1 + i].words_removed <= 1.25 * len(p) + 8  # a similar paragraph at an end goes with it
    assert " ".join(mixed) in gone(2 * n + 2)
    assert rows[2 * n + 3].n_removed == 0


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.fit(d.where(~held).select("text", "lang"))
    right = language_id.identify(d.where(held), model).join(d, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.97
    odd = language_id.identify(docs(spark, [None, "", "123 !", "word"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and 0 <= odd[3].score <= 1
    empty = language_id.fit(d.where("false").select("text", "lang"))
    assert language_id.identify(docs(spark, ["word"]), empty).first().lang_pred == "und"


def test_quality_classifier(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    grades = [rnd.randrange(3) for _ in range(600)]
    texts = [" ".join([*(word() for _ in range(40)), *([["%%% ###"], ["rude"], []][g])]) for g in grades]
    f = quality.Features()
    m = quality.fit_rows([f(t) for t in texts[:400]], np.array(grades[:400]), 3)
    assert m.thresholds[0] < m.thresholds[1]
    tails = m.tails(np.array([m.score(f(t)) for t in texts[400:]]))
    assert np.mean((tails[:, 1] >= 0.5) == (np.array(grades[400:]) == 2)) > 0.97
    rows = quality.rate(docs(spark, [None, "", texts[0]]), m).collect()
    assert len(rows) == 3 and all(0 <= r.tail_prob <= r.expected_grade <= 2 for r in rows)


def test_languages_are_those_of_plain_loops(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    model = language_id.fit(spark.createDataFrame(rows).select("text", "lang"), sample_per_language=20)
    texts = [r.text for r in rows[:60]] + ["", None, "½ ② Ⅷ", "²", "½ and word", "x", "日本語", "é" * 50]
    got = {r.doc_id: r for r in language_id.identify(docs(spark, texts), model).collect()}
    for n, t in enumerate(texts):
        letters = [c for c in (t or "").lower() if unicodedata.category(c).startswith("L")]
        if not letters:
            assert got[n].lang_pred == "und" and got[n].score == 0
            continue
        clean = "".join(c if unicodedata.category(c).startswith("L") else " " for c in t.lower())
        codes = [ord(c) for c in f" {' '.join(clean.split())} "]
        m = 2**32
        a = [c * 2654435761 % m for c in codes]
        b = [(x * 31 + y * 7) % m for x, y in zip(a, a[1:], strict=False)]
        c = [(x * 31 + y * 13) % m for x, y in zip(b, a[2:], strict=False)]
        grams = a + [x ^ x >> 15 for x in b] + [(x ^ x >> 13) * 2246822519 % m for x in c]
        v = {}
        for g in grams:
            v[g >> 19] = v.get(g >> 19, 0) + 1
        v = {k: math.log1p(x) * model.idf[k] for k, x in v.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * centre[k] for k, x in v.items()) / norm for centre in model.vectors]
        best = max(range(len(cos)), key=lambda k: cos[k])  # noqa: B023
        assert got[n].score == pytest.approx(min(1, max(0, cos[best])), abs=1e-9)
        assert got[n].lang_pred == model.langs[best] or sorted(cos)[-2] > cos[best] - 1e-9


def test_a_language_of_many_copies_is_learned(spark):
    rows = [("the same words over and over", "xx")] * 900 + [(noise(s, 80, "abcdefgh "), "yy") for s in range(50)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), sample_per_language=10)
    assert set(model.langs) == {"xx", "yy"}


def test_ratings_are_those_of_plain_loops(spark):
    texts = [noise(s, 300, "abcde fghij klm .,%# AB|") for s in range(30)] + ["", None, "%%% ##", "x" * 30, "é ½ 、"]
    rng = np.random.default_rng(0)
    m = quality.CumulativeLink(rng.normal(0, 0.3, quality.BUCKETS), np.array([-0.5, 0.4]))
    got = {r.doc_id: r for r in quality.rate(docs(spark, texts), m).collect()}
    for n, t in enumerate(texts):
        t = t or ""
        words = [w.lower() for w in t.split()]
        names = set()
        for w in words:
            bare = w.strip(".,;:!?\"'()[]") or w
            names |= {"w" + bare} | {f"p{bare[:k]}" for k in (4, 5, 6, 7) if len(bare) > k} | ({"t" + w[-3:]} if not w[-1].isalnum() else set())
        signs = sum(not (c.isalnum() or c.isspace()) for c in t)
        k = len(words)
        names |= {f"#size={k.bit_length()}", f"#letters={10 * sum(w.isalpha() for w in words) // (k + 1)}", f"#distinct={10 * len(set(words)) // (k + 1)}", f"#bars={10 * words.count('|') // (k + 1)}"}
        names |= {f"#capitals={10 * sum(w.isupper() for w in t.split()) // (k + 1)}", f"#signs={20 * signs // (len(t) + 1)}"}
        score = sum(m.weights[b] for b in {zlib.crc32(x.encode()) % quality.BUCKETS for x in names})
        tails = [1 / (1 + math.exp(x - score)) for x in m.thresholds]
        assert got[n].expected_grade == pytest.approx(sum(tails)) and got[n].tail_prob == pytest.approx(tails[1]) and got[n].keep == (got[n].tail_prob >= quality.TAIL)


def test_paragraph_classes_against_all_pairs(spark):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(150)] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(14):
            v = list(b)
            for _ in range(rnd.randint(0, 12)):
                v[rnd.randrange(len(v))] = word()
            texts.append(" ".join(v))
    table = common.staged(paragraphs.paragraph_table(docs(spark, texts), (24, 3, 2), "doc_id", "text"), "test-paragraphs")
    rows = {(r.k1, r.k2): r for r in table.collect()}
    classes = table.groupBy("k1", "k2", "b1", "b2", "b3").agg(F.min(F.struct("id", "h", "pos", "words")).alias("first"))
    got = {(r.k1, r.k2): r.component for r in paragraphs.similar_classes(classes, table, ["b1", "b2", "b3"], 0.8).collect()}
    keys = list(rows)
    sets = {k: paragraphs.shingles(rows[k].sh) for k in keys}
    near = [(a, b) for n, a in enumerate(keys) for b in keys[:n] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {k: n for n, k in enumerate(keys)}
    for _ in range(8):
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
    found = sum(a in got and got.get(a) == got.get(b) for a, b in near)
    assert len(near) > 60 and found >= 0.9 * len(near)  # the bands find 0.953 of pairs of just 0.8
    for c in set(got.values()):
        assert len({want[k] for k in got if got[k] == c}) == 1  # nothing is joined without a chain of similar paragraphs


CLASH = ["id", "h", "_id", "_h", "_a", "_b", "_digest", "_spans", "spans", "_nth", "a.b", "keep", "row", "file", "pos", "__found_id", "component", "label", "grade"]


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_stages_keep_columns_of_any_name(spark, stage):
    import corpus_pipeline

    long_ = [noise(s, 500, "abcdefgh ") for s in range(6)]
    texts = [*long_, long_[0], long_[1] + " x", long_[2].replace("a", "a", 1), "start " + long_[3][:400] + " end", None, "", "x"]
    d = docs(spark, texts, [*range(len(texts) - 1), None]).select("doc_id", "text", "lang", "source", "n_chars")
    for n, c in enumerate(CLASH):
        d = d.withColumn(c, F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")))
    d = common.staged(d, "clash")
    kept = corpus_pipeline.STAGES[stage][1](spark, d, "/root/testdata/sf0.001")
    assert kept.columns == d.columns
    rows = kept.collect()
    assert len(rows) <= len(texts) and (stage != 1 or len(rows) == len(texts) - 3)
    for r in rows:
        assert [r[c] for c in CLASH] == [None if r.doc_id is None else f"{n}-{r.doc_id}" for n in range(len(CLASH))]
    assert corpus_pipeline.STAGES[stage][1](spark, d.where("false"), "/root/testdata/sf0.001").count() == 0


def test_ids_that_are_no_numbers_are_refused(spark):
    d = spark.createDataFrame([("7", "x"), ("seven", "y")], "doc_id string, text string")
    assert token_counts.token_counts(d.where("doc_id = '7'"), tokenizer(BYTE)).first().doc_id == 7
    with pytest.raises(Exception, match="whole numbers"):
        token_counts.token_counts(d, tokenizer(BYTE)).collect()


def test_components(spark):
    rnd = random.Random(11)
    e = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    label = {x: x for p in e for x in p}
    for _ in label:
        for a, b in e:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in common.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if sum(v == c for v in label.values()) > 1}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, d, "/root/testdata/sf0.001")
        assert kept.columns == d.columns
        before, d = d.count(), common.staged(kept, "test")
        assert 0 < d.count() <= before
    assert d.selectExpr("count(*) = count(distinct doc_id)").first()[0]
    tokens = corpus_pipeline.STAGES[-1][1](spark, d, "")
    assert tokens.select("doc_id").distinct().count() == d.count()


def test_pipeline_cuts_each_text_once(spark):
    import corpus_pipeline

    rnd = random.Random(5)
    say = lambda n: " ".join(f"w{rnd.randrange(9999)}" for _ in range(n))
    passage = say(80)
    d = spark.createDataFrame([(1, f"{say(30)} {passage}"), (2, f"{passage} {say(30)}"), (3, passage), (4, None), (5, " ")], "doc_id long, text string")
    kept = corpus_pipeline.cut_repeats(spark, d, "")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    text = {r.doc_id: r.text for r in kept.collect()}
    assert set(text) == {1, 2, 4} and passage in text[1] and len(text[2].split()) == 30 and text[4] is None


def test_a_full_membership_filter_stays_within_its_8_mb(spark):
    members = spark.range(300_000)  # every bitmap of the filter has some
    rows = common.likely_in(spark.range(1000), F.col("id"), members, F.col("id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = rows._jdf.queryExecution().executedPlan()
        assert len(rows.collect()) == 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    todo, sizes = [plan], []
    while todo:
        p = todo.pop()
        todo += [p.children().apply(i) for i in range(p.children().length())]
        if p.nodeName() == "BroadcastExchange":
            sizes.append(p.metrics().apply("dataSize").value())
    assert len(sizes) == 1 and 4 << 20 < sizes[0] <= (8 << 20) + (64 << 10)


def test_the_driver_gives_back_what_a_fit_took_up(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(quality, "trim", lambda: calls.append(1), raising=False)  # before, there was none
    rows = docs(spark, ["one two", "three four"] * 10).select("text", (F.col("doc_id") % 2).cast("int").alias("grade"), F.xxhash64("doc_id").alias("h"))
    quality.fit(rows)
    assert calls == [1]
