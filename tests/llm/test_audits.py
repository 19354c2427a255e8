"""Decontamination, source divergence and the prefix trie against plain versions on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from atomweave.llm import decontamination, divergence, prefix_trie

WORDS11 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORDS12 = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def docs(spark, rows):
    """Rows ``doc_id, text, lang, source`` with columns that clash with names used inside."""
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], "doc_id long, text string, lang string, source string, items string, n_words int, term string")


def plain_hits(texts, items, n=10):
    """Per text: words, words hit, names of items that occur."""
    windows = {}
    for name, text in items:
        w = WORDS11.findall(lower(text))
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add("" if name is None else str(name))
    out = []
    for text in texts:
        w = WORDS11.findall(lower(text))
        hit, names = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    names |= own
        out.append((len(w), len(hit), sorted(names)))
    return out


def fixture11():
    rnd = random.Random(11)
    word = lambda: rnd.choice(["aa", "b", "É", "x1", "Zé", "q", "日本", "w" * 40])
    say = lambda n: " ".join(word() + rnd.choice(["", ",", ".", "-"]) for _ in range(n))
    items = [(n, say(rnd.choice([0, 1, 3, 9, 10, 11, 30]))) for n in range(14)] + [(None, say(12)), (3, say(10)), (3, None), (20, "..."), (21, "one two THREE"), (21, "one two three")]
    texts = [None, "", "...", "One-two_three", "one two", "x " * 40, *(say(rnd.randint(0, 60)) for _ in range(40))]
    texts += [f"{say(5)} {items[rnd.randrange(len(items))][1]} {say(5)}" for _ in range(30)] + ["word " * 30000 + items[0][1]]
    return texts, items


@pytest.mark.parametrize("most", [decontamination.WINDOWS, 8])
def test_decontamination_equals_plain_windows(spark, most, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 7)  # long items come in pieces
    texts, items = fixture11()
    d = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.with_hits(d, bench, most=most).collect()
    want = plain_hits(texts, items)
    for r in rows:
        f = r.found
        assert (f.n_words, sum(s.words for s in f["spans"]), f["items"]) == want[r.doc_id], texts[r.doc_id]
        for s in f["spans"]:
            assert len(WORDS11.findall(lower(r.text[s.start : s.stop]))) == s.words
    assert len(rows) == len(texts) and any(w[1] for w in want) and not all(w[1] for w in want)


def test_decontamination_removes_spans_or_documents(spark):
    d = docs(spark, [(1, "Before one, TWO three after", "en", "s"), (1, "Before one, TWO three after", "en", "s"), (2, "one two", None, "s"), (None, None, "en", None)])
    bench = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    cut = decontamination.decontaminate(d, bench)
    assert cut.columns == d.columns and sorted(str(r.text) for r in cut.collect()) == ["Before after", "Before after", "None", "one two"]
    assert sorted(str(r.doc_id) for r in decontamination.decontaminate(d, bench, how="documents").collect()) == ["2", "None"]
    for docs_, bench_ in ((d.limit(0), bench), (d, bench.limit(0))):
        found = decontamination.contamination(docs_, bench_).collect()
        assert all(r.n_hit == 0 and r["items"] == [] for r in found) and len(found) == docs_.count()
    with pytest.raises(ValueError):
        decontamination.decontaminate(d, bench, how="words")


def plain_divergence(rows, least, smooth=5, scale=10**9, top=50):
    rows = [(lang or "", source or "", WORDS12.findall(lower(text))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        kept = [t for t, n in Counter(t for r in own for t in set(r[2])).items() if n >= least]
        sources = sorted({r[1] for r in own})
        counts = {s: Counter(t for r in own if r[1] == s for t in r[2]) for s in sources}
        every = sum(counts.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + scale * (c[t] + smooth) // (total + smooth * len(kept)) for t in kept}

        p, q = {s: shares(counts[s]) for s in sources}, shares(every)
        for s in sources:
            pair = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, n) for n, (v, o) in enumerate(pair, 1)]
            term = sorted(((p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, v, n) for n, (v, t) in enumerate(term[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "gathered"), [(3, 200_000), (1, 5), (10**6, 5)])
def test_divergence_equals_plain_counts(spark, monkeypatch, least, gathered):
    monkeypatch.setattr(divergence, "GATHERED", gathered)
    monkeypatch.setattr(divergence, "TOGETHER", 50)
    rnd = random.Random(least)
    word = lambda: rnd.choice(["a", "B", "b", "É", "é", "zz", "日", "x9y", "o'k", "µ"])
    rows = [(" ".join(word() for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "S3", None, "é"])) for _ in range(120)]
    rows += [(None, "xx", "alone"), ("", "fr", "one"), ("a b", "fr", "two"), *rows[:5], ("a " * 500, "en", "s1")]
    got = divergence.divergence(docs(spark, [(0, *r) for r in rows]), least_docs=least, top=4)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows, least, top=4)
    assert divergence.divergence(docs(spark, [])).count() == 0


def test_shares_are_exact_beyond_longs(spark):
    n = 3 * 10**18
    row = spark.range(1).select(divergence.share(F.lit(n - 10), F.lit(n), F.lit(7), 5, 10**9).alias("p")).first()
    assert row.p == 1 + 10**9 * (n - 5) // (n + 35)


def plain_trie(rows):
    """Nodes of rebuilt conversations as the query defines them."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            x = (role or "", text or "")
            key = hashlib.sha256(f"{len(x[0])}:{x[0]}{x[1]}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, key), x))
    own = {c: [x for _, x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + t[h:]
    nodes = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        kids = [s for s in below if len(s) == len(seq) + 1]
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(seq)))
        leaves = sum(1 for s in below if not any(o[: len(s)] == s and len(o) == len(s) + 1 for o in below))
        saved = sum((len(nodes[s]) - 1) * len(s[-1][1]) for s in below if s)
        out.append((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(350), 60):
        shared = rnd.choice([0, 0, 3, 12])
        for t in range(shared):
            rows.append((c, t, "user", f"same {t}"))
        rows += [(c, shared + t, rnd.choice(["user", "bot", None]), rnd.choice(["hi", "é😀", "", None, "long " * 50])) for t in range(rnd.randint(1, 4))]
    return rows


@pytest.mark.parametrize("case", ["mixed", "odd", "one", "equal"])
def test_prefix_trie_equals_plain_trie(spark, tmp_path, case, monkeypatch):
    from atomweave.llm import queries

    monkeypatch.setattr(prefix_trie, "RANGE", 16)
    rows = {
        "mixed": trie_rows(1),
        "odd": [*trie_rows(2), (7, None, "user", "first"), (7, None, "user", "first"), (7, 1, None, None), (8, 5, "a", "b"), (8, 5, "a", "c"), (None, 1, "x", "y"), (200, 0, "user", "same 0"), (201, 0, "user", "x")],
        "one": [(5, 1, "user", "hi")],
        "equal": [(c, t, "user", f"turn {t}") for c in range(40) for t in range(15)],
    }[case]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"d": F.lit("clash"), "cls": F.lit(1)})
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op13_prefix_trie(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rows)


def test_prefix_trie_of_nothing(spark):
    ranked = prefix_trie.ranked_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    trie = prefix_trie.prefix_trie(ranked, prefix_trie.lengths(ranked))
    assert trie.nodes.count() == 0 and prefix_trie.ends_digests(trie.ends).count() == 0


def test_the_pipeline_equals_plain_stages(spark, tmp_path):
    """Every stage against a plain version of it, but for the ratings, which come from the fitted model."""
    from itertools import combinations

    import corpus_pipeline
    from atomweave.llm import encoding, quality, queries

    rnd = random.Random(31)
    vocabulary = ["".join(rnd.choice("aeioubdklmnrst") for _ in range(rnd.randint(3, 8))) for _ in range(3000)]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    base = [say(rnd.randint(120, 200)) for _ in range(30)]
    passage = say(70)
    texts = [" ".join(t) for t in base]
    texts += [t.replace(" ", "  ") for t in texts[:5]]  # equal but for blanks, and longer
    for t in base[5:12]:  # a word changed: near copies
        t = list(t)
        t[60] = "changed"
        texts.append(" ".join(t))
    texts += [" ".join(say(90) + passage + say(80)) for _ in range(4)] + ["", None, "one word"]
    rows = [(n, t, "en", "s", len(t or "")) for n, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(n, 1, 0) for n in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {r.doc_id: r.text for r in quality.select_rated(d, queries.quality_model(spark, d, str(tmp_path))).collect()}
    assert len(left) > 30
    groups: dict = {}
    for i, t in left.items():
        groups.setdefault("".join((t or "").split()), []).append(i)
    keep = {min(own, key=lambda i: (-len(left[i] or ""), i)) for own in groups.values()}
    left = {i: t for i, t in left.items() if i in keep}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in left.items() if (w := (t or "").split())}
    up = {i: i for i in left}
    for _ in range(len(up)):
        for i, j in combinations(sorted(shingles), 2):
            both = len(shingles[i] & shingles[j])
            if both >= 0.8 * (len(shingles[i]) + len(shingles[j]) - both):
                up[i] = up[j] = min(up[i], up[j])
    left = {i: t for i, t in left.items() if up[i] == i}
    cut = {}
    for i in sorted(left):  # the first text that has the passage keeps it
        words = (left[i] or "").split()
        at = next((k for k in range(len(words)) if words[k : k + 70] == passage), None)
        if at is not None and any(" ".join(passage) in " ".join((left[j] or "").split()) for j in left if j < i):
            words = words[:at] + words[at + 70 :]
        cut[i] = words
    docs_ = d
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = stage(spark, docs_, str(tmp_path))
    got = {r.doc_id: (r.text or "").split() for r in docs_.collect()}
    assert set(got) == {i for i, w in cut.items() if w or left[i] is None} and len(got) >= 30
    assert all(got[i] == cut[i] for i in got)
    tok = encoding.Encoder(queries.tokenizer("word_bpe_49k.json")).tok
    want = {i: [*tok.encode(" ".join(w), add_special_tokens=False).ids, 1] for i, w in got.items()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.length for r in pieces} == {i: len(x) for i, x in want.items()}  # all are shorter than a sequence
    assert {r.doc_id: r.ids_crc32 for r in pieces} == {i: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)) for i, ids in want.items()}
    full: dict = {}
    for r in pieces:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in own) <= 4096 and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False)) for own in full.values())
