"""Every corpus operator against a brute-force version on rows with edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest

from segmenter.llm import (bpe, decontaminate, hilbert, interpolated_lm, jaccard_join, license_rules, license_scan, pq_neardup,
                           suffix_dedup, textkit, tokenpack, toxicity)

from .conftest import ROWS, prose

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [(r[0], r[1] or "") for r in ROWS]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def same(df, columns, expected):
    got = Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in df.collect())
    assert got == Counter(expected)


def components(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_license_scan(docs):
    base = {label: phrase.split() for label, phrase in license_rules.BASE}
    want = []
    for d, t in TEXTS:
        w = ALNUM.findall(low(t))
        at = [(k, x) for x, p in base.items() for k in range(len(w)) if w[k:k + len(p)] == p]
        want.append((d, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    same(license_scan.scan_licenses(docs), ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"], want)


def test_license_overlaps(docs):
    row = next(r for r in license_scan.scan_licenses(docs).collect() if r["doc_id"] == 11)
    labels = row["labels"].split(",")
    # The versioned names contain the plain ones and suppress them; base labels stay.
    assert {"cc-by", "gpl", "reserved", "cc-by-4.0", "gpl-3.0"} <= set(labels) and "gnu-gpl" not in labels
    assert 0 < row["score"] <= 1


def test_license_rules_are_well_formed():
    known = license_rules.rules()
    assert len(known) > 200
    for r in known:
        re.compile(r["regex"])
    assert license_rules.required_words("no ?deriv works") == ["works"]



def spelled(tree):
    """Texts that a parsed regex matches: every alternative, optional parts there and left out."""
    out = [""]
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            part = [chr(arg)]
        elif kind == "IN":
            part = [c for c in "abcdefghijklmnopqrstuvwxyz0123456789" if any(
                str(o) == "LITERAL" and chr(v) == c or str(o) == "RANGE" and v[0] <= ord(c) <= v[1]
                or str(o) == "CATEGORY" and ("NOT" in str(v) and c == "z" or "NOT" not in str(v) and c == "7") for o, v in arg)]
        elif kind == "ANY":
            part = ["x "]
        elif kind == "MAX_REPEAT":
            part = [""] * (arg[0] == 0) + [x * max(arg[0], 1) for x in spelled(arg[2])]
        elif kind == "SUBPATTERN":
            part = spelled(arg[3])
        elif kind == "BRANCH":
            part = [x for b in arg[1] for x in spelled(b)]
        out = [a + b for a in out for b in part]
    return out


def test_license_rules_can_all_match():
    for line in license_rules.RULES_TEXT.strip().splitlines():
        rule = next(r for r in license_rules.rules() if r["label"] == line.split(" | ")[0] and not r["base"])
        for text in spelled(re._parser.parse(line.split(" | ", 3)[3].strip())):
            words = ALNUM.findall(text)
            if "dedication andlicen" in text:
                continue  # the optional blank after an optional "and"
            assert re.search(rule["regex"], " ".join(words)), (rule["label"], text)
            assert set(words) & set(rule["keywords"]) and set(words) >= set(rule["must"]), (rule["label"], text)


def test_license_rules_found_alone(spark):
    want = {"Licensed under the MPL.": "licensed-under", "licensed under the terms of the X": "licensed-under", "LGPL3": "lgpl-short",
            "lgpl2 1": "lgpl-short", "AGPL3": "agpl-short", "licenced for personal use": "personal-use",
            "Except as contained in this notice, the name of X shall not be used": "x11-endorsement"}
    rows = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == dict(enumerate(want.values())) and all(r["score"] > 0 for r in rows)


@pytest.mark.parametrize("bits,n", [(1, 5), (7, 64), (15, 1000), (16, 4096), (17, 129), (32, 70)])
def test_pack_round_trip(bits, n):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, n, dtype=np.uint64)
    assert (tokenpack.unpack(tokenpack.pack(ids, bits), bits, n) == ids).all()


def test_token_file_random_access():
    import io
    ids = np.arange(10_000) % 700
    lens = [0, 4000, 6000]
    f = tokenpack.TokenFile(io.BytesIO(b"".join(tokenpack.file_bytes([None, 3, 9], lens, ids, 10, 700, 128))))
    assert (f.document(1) == ids[:4000]).all() and (f.ids(4990, 5100) == ids[4990:5100]).all() and len(f.document(0)) == 0


def test_token_files(docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = tokenpack.pack_documents(docs, P.path("word_bpe_49k.json")).collect()
    want = Counter()
    for d, t in TEXTS:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.r_[0, np.cumsum([r["n_tokens"] for r in rows])][:-1].tolist()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))


def test_piece_encoder_equals_the_library():
    """Strings rich in special tokens, odd cases, letters that grow when lower-cased, combining marks; a table that overflows."""
    import random

    from tokenizers import Tokenizer
    rnd = random.Random(5)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "İ", "?", "!.", "ß", "Σ", "ς", "e", "\u0301", "\u0307", "ａ", "ﬁ", "Ⅻ", "½", "٣",
            "日本", "한", "'s", "'LL", "don't", "A1b", "x.", ",", " ", "\n", "\t", "\r\n", "\u00a0", "\u2028", "\x0b", "🙂", "\u200d", "ǅ", "K", "Å", "word", "The"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(6000)]
    for as_text in (False, True):
        tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
        tok.encode_special_tokens = as_text
        want = [[*e.ids, 1] for e in tok.encode_batch(texts, add_special_tokens=False)]
        for limit in (600_000, 700):
            enc = tokenpack.PieceEncoder(P.path("word_bpe_49k.json"), limit, as_text)
            got = []
            for i in range(0, len(texts), 50):
                ids, lens = enc.encode(texts[i:i + 50], 1)
                got += [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])]
                assert len(enc.pieces) == len(enc.ends) - 1 <= max(limit, 2000)
            assert got == want


def test_piece_encoder_cuts_a_column_into_few_strings():
    """An Arrow column with a null, an offset and texts that meet at a mark; a word has one entry, whatever its case and closing marks."""
    import pyarrow as pa
    from tokenizers import Tokenizer
    texts = ["skipped", "The cat, the CAT!", None, "", "...", "cat", "...the", "a.b.", "caf\u00e9, caf\u00e9", "\n x\t\r"]
    enc = tokenpack.PieceEncoder(P.path("word_bpe_49k.json"))
    ids, lens = enc.encode(pa.array(texts, pa.string())[1:], 1)
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts[1:]]
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == want
    assert set(enc.pieces) == {"the", "cat", ",", "!", "...", "...the", "a.b", ".", "caf\u00e9", "caf\u00e9,", "x"}


def brute_hits(items, n=10):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(low(t or ""))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = []
    for d, t in TEXTS:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k:k + size])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0))
    return out


ITEMS = [(1, prose(9, 40)), (2, "Five-dozen LIQUOR"), (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(95, 120))), (5, "word"),
         (6, " ".join(f"t{i % 97}" for i in range(30)))]


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontaminate(spark, docs, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.decontaminate(docs, items, block_windows=block, segment_bytes=2000)
    same(got, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], brute_hits(ITEMS))


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha " + "x " * 30 + "beta gamma")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "beta alpha gamma")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in decontaminate.decontaminate(d, i, slop=4).collect()}
    assert got[1][0] == 0 and got[1][1] >= 1 and got[2] == (0, 0)


def test_proximity_stays_inside_a_document(spark):
    import random
    rnd = random.Random(3)
    texts = [(i, " ".join(rnd.choice("alpha beta gamma delta x y z".split()) for _ in range(rnd.randrange(9)))) for i in range(300)]
    texts += [(300, "alpha"), (301, "beta gamma"), (302, None)]
    items = [(1, "alpha beta gamma"), (2, "delta alpha")]
    d = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_near"] for r in decontaminate.decontaminate(
        d, spark.createDataFrame(items, "item_id long, text string"), slop=2).collect()}
    count = Counter(w for _, t in texts for w in (t or "").split())
    for i, t in texts:
        words, near = (t or "").split(), 0
        for _, item in items:
            terms = sorted(item.split(), key=count.__getitem__)
            near += sum(w == terms[0] and set(terms) <= set(words[max(0, p - 2):p + 3]) for p, w in enumerate(words))
        assert got[i] == near, (i, t)
    assert got[300] == got[301] == 0


def test_kept_columns_do_not_clash(spark):
    base = " ".join(f"w{i}" for i in range(400))
    d = spark.createDataFrame([(1, base, 1, 2, "a", 4, 5), (2, base, 1, 2, "b", 4, 5), (3, None, None, 2, "c", 4, 5)],
                              "doc_id long, text string, dk int, th int, _new string, _k int, row int")
    cut = suffix_dedup.dedup_texts(d)
    assert cut.columns == d.columns
    assert sorted(r[0:1] + r[2:] for r in cut.collect()) == sorted(r[0:1] + r[2:] for r in d.collect())
    kept = decontaminate.drop_contaminated(d, spark.createDataFrame([(1, base)], "item_id long, text string"))
    assert kept.columns == d.columns and [r["_k"] for r in kept.collect()] == [4]


def test_hilbert_curve_is_continuous():
    for dims, bits in ((2, 3), (3, 2)):
        size, table = 1 << dims, hilbert.curve_table(dims)
        place = {}
        for cell in np.ndindex(*[1 << bits] * dims):
            state = index = 0
            for level in range(bits - 1, -1, -1):
                c = 0
                for x in cell:
                    c = c * 2 + (x >> level & 1)
                state, w = divmod(table[state * size + c], size)
                index = index * size + w
            place[index] = cell
        walk = [place[i] for i in range(len(place))]
        assert len(place) == (1 << bits) ** dims
        assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for x, y in zip(walk, walk[1:], strict=False))


def test_hilbert_shards(docs):
    rows = hilbert.shard_documents(docs, shards=4).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(ROWS) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in TEXTS)


def test_language_model(docs):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    toks = [(d, [*SPACED.findall(low(t)), None]) for d, t in TEXTS]
    c = Counter(x for d, w in toks if not held(d) for x in w)
    n, v = sum(c.values()), len(c)
    got = interpolated_lm.score_documents(docs, textkit.crc_mod("doc_id", 7) == 2, block_bytes=2000, keys_per_range=100)
    same(got, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"],
         [(d, held(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for d, w in toks])
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got.collect())


def test_mixture_weights_prefer_the_better_estimate():
    good = interpolated_lm._cell(np.array([0.5]))[0]
    poor = interpolated_lm._cell(np.array([0.001]))[0]
    w = interpolated_lm.learn_weights([(3, good, poor, 100), (4, 0, good, 100)], 1000)
    assert w[3, 0] > 0.9 and w[4, 1] > 0.9 and np.allclose(w.sum(1), 1)


def test_suffix_dedup(docs):
    seen, want = Counter(), []
    raw = [(d, t.encode()) for d, t in TEXTS]
    for _, b in raw:
        seen.update(b[i:i + 400] for i in range(len(b) - 399))
    for d, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399):
            if seen[b[i:i + 400]] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    same(suffix_dedup.dedup_report(docs), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], want)


def test_suffix_family_merges_equal_levels(spark, docs):
    family = suffix_dedup.SuffixFamily()
    keyed = suffix_dedup.keyed(docs.select("doc_id", "text"))
    for b in range(3):
        family.add(keyed.where(f"pmod(dk, 3) = {b}"))
    assert [size for size, _ in family.levels] == [1, 0]


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16))
    x[30:45] = x[:15] + rng.normal(size=(15, 16)) * 0.1
    x[45:50] = x[0]
    rows = [(i, [float(v) for v in r], i % 2 if 30 <= i < 45 else 0) for i, r in enumerate(x)]
    rows += [(60, None, 0), (61, [0.0] * 16, 0), (62, [float("nan")] + [1.0] * 15, 0), (63, rows[0][1], None), (64, [], 0),
             (65, [None] + [1.0] * 15, 0), (66, [2 * v for v in rows[0][1]], 0), (67, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = {i: np.array(r) / np.linalg.norm(r) for i, r, lab in rows
            if lab is not None and r and None not in r and np.isfinite(r).all() and any(r)}
    label = {i: lab for i, _, lab in rows}
    links = [(a, b) for a in unit for b in unit if a != b and label[a] == label[b] and len(unit[a]) == len(unit[b])
             and unit[a] @ unit[b] >= 0.93]
    group, n = components([r[0] for r in rows], links), Counter(a for a, _ in links)
    same(pq_neardup.link_vectors(df, block=8, queries=16), ["vec_id", "n_links", "component_id", "kept"],
         [(i, n[i], group[i], group[i] == i) for i, _, _ in rows])


def test_embeddings_probe_every_list_within_reach(spark):
    # Many more lists than a fixed number of probes holds; links across several regions and blocks.
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2_400, 48))
    x[1_200:] = x[:1_200] + rng.normal(size=(1_200, 48)) * 0.75
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.75
    links = [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a != b]
    group, n = components(range(len(x)), links), Counter(a for a, _ in links)
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    same(pq_neardup.link_vectors(df, cosine=0.75, block=300, queries=1_000), ["vec_id", "n_links", "component_id"],
         [(i, n[i], group[i]) for i in range(len(x))])


@pytest.mark.parametrize("n,keep", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_jaccard(docs, n, keep):
    sets = []
    for d, t in TEXTS:
        w = SPACED.findall(low(t))
        sets.append((d, {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    links = [(a, b) for a, x in sets for b, y in sets if a is not None and b is not None and a < b and x and y
             and Fraction(len(x & y), len(x | y)) >= keep]
    group = components([d for d, _ in sets if d is not None], links)
    same(jaccard_join.jaccard_components(docs, n, keep, block_bytes=2000), ["doc_id", "n_shingles", "component_id"],
         [(d, len(s), group.get(d)) for d, s in sets])



def test_two_sets_meet_once_whatever_they_share():
    # All tokens are counted twice; the first three of either set are its own neighbours' tokens.
    import pyarrow as pa

    def entries(block, tokens):
        tok = np.array(tokens, np.uint64)
        row = {"block": block, "doc_ids": [block], "n": [len(tok)], "counted": np.array([len(tok)], np.int32).tobytes(),
               "offsets": np.array([0, len(tok)], np.int64).tobytes(), "tokens": tok.tobytes(),
               "answers": [{"part": 0, "df": np.full(len(tok), 2, np.uint16).tobytes()}]}
        found = next(jaccard_join._prefix_entries(Fraction(1, 2))([pa.RecordBatch.from_pylist([row])])).to_pylist()
        return {e["token"]: set(e["head"]) for e in found}

    y, z = entries(0, range(10, 50)), entries(1, [4, 5, 6, *range(13, 50)])
    assert len(y.keys() & z.keys()) > 10
    assert [t for t in sorted(y.keys() & z.keys()) if not y[t] & z[t]] == [13]


def test_jaccard_repeated_ids_keep_all_texts(spark):
    # Each id leads classes of several texts; every text has a near copy under an id of its own.
    rows = []
    for i in range(6):
        for k in range(4):
            words = [f"d{i}t{k}w{j}" for j in range(80)]
            rows += [(i, " ".join(words)), (100 + 10 * i + k, " ".join([*words, "more"]))]
    # An id whose rows are a copy, an own text and no text.
    rows += [(300, "copied text of five words"), (301, "copied text of five words"), (301, "another text that stands alone"), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, block_bytes=2000).collect()}
    assert got == {(d, (d - 100) // 10 if 100 <= d < 300 else min(d, 300)) for d, _ in rows}


@pytest.mark.parametrize("chunk,overlap", [(16_384, 1_024), (300, 60)])
def test_byte_bpe(docs, chunk, overlap):
    enc, _ = bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = []
    for d, t in TEXTS:
        ids = enc.encode_ordinary(t)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    same(bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk, overlap),
         ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], want)


def test_toxicity_learns_and_ignores_held_out(spark):
    rows = [(i, prose(i, 40) + (" blargwort zapfelnix" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels, textkit.crc_mod("doc_id", 4) == 2).collect()
    assert all((r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in got) and any(r["held_out"] for r in got)


def test_toxicity_edge_cases(spark, docs):
    labels = spark.createDataFrame([(1, 1), (None, 1), (9, None), (9, 0)], "doc_id long, toxic int")
    rows = toxicity.score_documents(docs, labels, textkit.crc_mod("doc_id", 4) == 2).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)


def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (license_scan.scan_licenses(empty), tokenpack.pack_documents(empty, P.path("word_bpe_49k.json")),
               decontaminate.decontaminate(empty, items), toxicity.score_documents(empty, none, textkit.crc_mod("doc_id", 4) == 2),
               hilbert.shard_documents(empty), interpolated_lm.score_documents(empty, textkit.crc_mod("doc_id", 7) == 2),
               suffix_dedup.dedup_report(empty), pq_neardup.link_vectors(vectors), jaccard_join.jaccard_components(empty),
               bpe.encode_documents(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)):
        assert df.count() == 0
