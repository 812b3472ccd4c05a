"""The operators against brute force on whole small tables."""

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm import fingerprints, licenses, mixing, neighbours, packing, queries, sharding, simhash, suffix, tokens, toxicity

SF = "/root/testdata/sf0.01"
NAMES = queries.queries()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def test_op1_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(licenses.oracle_sql()).fetchall())
    got = sorted(tuple(r) for r in NAMES["op1_license_scans"](spark, SF).select("doc_id", "license", "score", "n_units").collect())
    assert got == want and got


def test_op1_finds_licences_inside_texts(spark):
    """Whole licences as three paragraphs after others, with either line ends, and every whole template by itself."""
    mit = licenses.TEMPLATES["mit"]
    a, b = mit.index("The above copyright"), mit.index("THE SOFTWARE IS")
    inside = "\n\n".join(["word " * 120, mit[:a], mit[a:b], mit[b:], "and more words here"])
    rows = [(1, inside), (2, inside.replace("\n", "\r\n")), (3, "Copyright (c) 2020\n" + licenses.TEMPLATES["bsd-3-clause"]), (4, "nothing")]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, "mit"), (2, "mit"), (3, "bsd-3-clause")} <= got and not any(d == 4 for d, _ in got)
    whole = spark.createDataFrame(list(enumerate(licenses.TEMPLATES.values())), "doc_id long, text string")
    found = {(r["doc_id"], r["license"]): r["score"] for r in licenses.scan_licenses(whole).collect()}
    assert all(found[i, name] == 1.0 for i, name in enumerate(licenses.TEMPLATES))


def test_op1_size_bounds_prune_nothing_that_matches():
    for size in range(1, 60):
        low, high = licenses.size_bounds(size, 0.8)
        fits = [n for n in range(1, 200) if 2 * min(n, size) / (n + size) >= 0.8 - 1e-12]
        assert (fits[0], fits[-1]) == (max(1, low), high)


def test_op2_matches_brute_force(spark, texts):
    length = 400
    raw = {d: t.encode() for d, t in texts.items()}
    seen = Counter(xxhash.xxh3_128_digest(x[i : i + length]) for x in raw.values() for i in range(len(x) - length + 1))
    for r in NAMES["op2_suffix_dedup"](spark, SF).collect():
        x = raw[r["doc_id"]]
        mark = np.zeros(len(x) + 1, np.int64)
        for i in range(len(x) - length + 1):
            if seen[xxhash.xxh3_128_digest(x[i : i + length])] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("hot", [1, 3_000])
def test_op2_hot_anchors_give_the_same(docs, hot):
    plain = suffix.remove_repeats(docs)
    split = suffix.remove_repeats(docs, suffix.Repeats(hot_bytes=hot, index_bytes=20_000))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))


def _repeated_runs(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Merged runs of bytes that lie in strings of ``length`` bytes which start more than once."""
    seen = Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    out = []
    for x in texts:
        mark = np.zeros(len(x) + 1, np.int64)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        edges = np.diff(np.concatenate([[0], (np.cumsum(mark)[: len(x)] > 0).astype(int), [0]]))
        out.append(list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)))
    return out


def _passage_texts() -> list[str]:
    rng = np.random.default_rng(4)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, int(k)))) for k in rng.integers(2, 9, n))
    shared, short, long_ = words(55), words(30), words(200)
    texts = [words(int(n)) for n in rng.integers(5, 300, 40)]
    for k in range(0, 40, 3):
        texts[k] = f"{texts[k]} {shared if k % 2 else long_} {texts[(k + 1) % 40][:50]}"
        texts[(k + 7) % 40] += " " + short
    return [*texts, texts[3], "", "字" * 300 + texts[0], texts[1] + "字" * 300]


def test_op2_passages_match_brute_force(spark):
    texts = _passage_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    raw = [t.encode() for t in texts]
    outer, inner = _repeated_runs(raw, 160), _repeated_runs(raw, 400)
    for r in suffix.remove_repeats(rows).collect():
        x = raw[r["doc_id"]]
        runs = [x[a:b] for a, b in outer[r["doc_id"]] if b - a >= 400 or len(x[a:b].split()) >= 50]
        assert (r["n_passages"], r["passage_bytes"]) == (len(runs), sum(map(len, runs)))
        assert (r["n_removed"], r["n_spans"]) == (sum(b - a for a, b in inner[r["doc_id"]]), len(inner[r["doc_id"]]))
    want = {}
    for k, (x, runs) in enumerate(zip(raw, outer, strict=True)):
        at = 0
        kept = b""
        for a, b in runs:
            if b - a >= 400 or len(x[a:b].split()) >= 50:
                while a < b and x[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(x) and x[b] & 0xC0 == 0x80:
                    b -= 1
                kept, at = kept + x[at:a], b
        text = (kept + x[at:]).decode()
        if text.strip() or text == texts[k]:
            want[k] = text
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_passages(spark, rows.withColumn("n_chars", F.lit(0)), SF).collect()} == want


@pytest.mark.parametrize("seed", range(12))
def test_op2_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    letters = [b"ab", b"a", bytes(range(256))][seed % 3]
    base = bytes(rng.choice(list(letters), 200).tolist())
    parts = [base[a : a + int(rng.integers(0, 120))] for a in rng.integers(0, 150, 9).tolist()]
    found, part = suffix.matching_statistics(parts)
    at = np.cumsum([0, *[len(p) + 1 for p in parts]])
    for k in (1, 2, 7, 40):
        count = Counter(p[i : i + k] for p in parts for i in range(len(p) - k + 1))
        for no, p in enumerate(parts):
            for i in range(len(p) - k + 1):
                assert (found[at[no] + i] >= k) == (count[p[i : i + k]] > 1)


def test_op2_hashes_by_blocks(monkeypatch):
    """Blocks of any length give the same hashes and minima as one."""
    buffer = np.random.default_rng(5).integers(0, 256, 1000).astype(np.uint8)
    whole = suffix._rolling(buffer, 32, 1)
    least = [whole[i : i + 129].min() for i in range(len(whole) - 128)]
    assert suffix._smallest(whole, 129).tolist() == least
    for block in (1, 7, 969, 970):
        monkeypatch.setattr(suffix, "BLOCK", block)
        assert (suffix._rolling(buffer, 32, 1) == whole).all()
        assert suffix._smallest(whole, 129).tolist() == least
    assert len(suffix._rolling(buffer[:32], 32)) == 1


@pytest.mark.parametrize("letters", [b"a", b"ab", b"\0\1", b"\xfe\xff", bytes(range(256))])
def test_op2_suffix_order(letters):
    """Against sorting, end signs by their place: parts of a few bytes, empty and equal ones, with and without byte 255."""
    rng = np.random.default_rng(len(letters))
    for sizes in ([0], [1], [1, 0], [2, 3], [0, 7, 8, 9], [300, 40, 300, 5]):
        parts = [bytes(rng.choice(list(letters), n).tolist()) for n in sizes] * 2
        parts = parts[: max(1, len(parts) - len(sizes) % 2)]
        suffixes = [([b + 1 for b in p[i:]] + [0], no) for no, p in enumerate(parts) for i in range(len(p) + 1)]
        order, code, rest, part = suffix.suffix_order(parts)
        assert order.tolist() == sorted(range(len(suffixes)), key=suffixes.__getitem__)
        assert [(s[0], len(s) - 1, no) for s, no in suffixes] == list(zip(code.tolist(), rest.tolist(), part.tolist(), strict=True))


def test_op2_suffix_order_without_room_for_positions():
    """Two million bytes and more are sorted by index; the order is the same."""
    parts = [b"abcab" * 260_000, b"cabca" * 240_000]
    small = [p[:5000] for p in parts]
    for p in (parts, small):
        order, code, rest, part = suffix.suffix_order(p)
        assert (np.bincount(order, minlength=len(order)) == 1).all()
        assert (code[order][1:] >= code[order][:-1]).all()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        a, b = order[:-1], order[1:]
        same = (code[a] == code[b]) & (code[a] > 0)
        assert (place[a[same] + 1] < place[b[same] + 1]).all()


def test_op3_laws(spark, texts):
    got = NAMES["op3_histogram_shards"](spark, SF).toPandas()
    assert len(got) == len(texts)
    by = got.groupby("shard")
    assert set(by.groups) == set(range(16))
    largest = got["size"].max()
    assert by["size"].sum().max() - by["size"].sum().min() <= 2 * largest
    for _, rows in by:
        assert sorted(rows["slot"]) == list(range(len(rows)))
    for r in got.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_op3_cuts_are_exact(spark):
    rows = spark.range(5000).selectExpr("cast((id * 7919) % 1000 as long) AS key", "cast(1 + id % 13 AS long) AS size")
    table = rows.toPandas()
    for c in sharding.find_cuts(rows, 8):
        below = table[table["key"] < c.key]
        assert (c.below_bytes, c.below_rows) == (below["size"].sum(), len(below))


def test_op4_matches_the_library(spark, texts, library):
    for r in NAMES["op4_token_counts"](spark, SF).collect():
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)


def test_op5_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.stack(table["embedding"]).astype(np.float64), table["vec_id"].to_numpy()
    got = NAMES["op5_nearest_neighbours"](spark, SF).toPandas()
    hits = 0
    for q, rows in got.groupby("query_id"):
        s = (x * x[ids == q][0]).sum(axis=1)
        s[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(rows["vec_id"]))
        np.testing.assert_allclose(rows.set_index("vec_id")["score"], s[[int(np.flatnonzero(ids == v)[0]) for v in rows["vec_id"]]], rtol=0, atol=1e-12)
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum() == 0.9 * len(got)


def test_op5_shelves_hold_all_parts():
    plan = neighbours.shelves({0: 5, 1: 5, 2: 25, 3: 3, 4: 9}, 10)
    load = Counter()
    for part, first, n in plan:
        for k in range(first, first + n):
            load[k] += {0: 5, 1: 5, 2: 25, 3: 3, 4: 9}[part] / n
    assert max(load.values()) <= 10 and [p for p, _, _ in plan] == [0, 1, 2, 3, 4]


def test_op6_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = NAMES["op6_toxicity"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held["doc_id"]]).all()
    assert (held["predicted"] == held["toxic"]).mean() > 0.95
    assert held["score"].between(0, 1).all()


def test_op6_weights_are_sparse():
    rows = [(toxicity.features(f"good words {i}" if i % 3 else f"vile words {i}"), int(i % 3 == 0)) for i in range(300)]
    number, weight = toxicity.fit_rows(lambda: rows, toxicity.Ftrl())
    assert 0 < len(number) < 30 and np.isfinite(weight).all()


def test_op7_round_trip(spark, texts, library):
    got = NAMES["op7_retrieval_packing"](spark, SF).toPandas()
    ids = {d: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in texts.items()}
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert got["length"].sum() == sum(map(len, ids.values())) and not got.duplicated(["doc_id", "start"]).any()
    rows = got.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id")["length"].cumsum() - rows["length"] == rows["offset"]).all()
    filled = rows.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 1024 and (1024 * len(filled) - filled.sum()) < 0.02 * filled.sum()


def test_op7_common_tokens_are_searched():
    docs = [np.array(x, "<u2") for x in ([5, 6, 7, 0], [8, 9, 0], [5, 6, 7, 0], [5, 6, 7, 0])]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1 << 16).astype(float)
    mean = sum(map(len, docs)) / len(docs)
    index = packing.Index(docs, df, len(docs), mean, packing.Bm25())
    for seed, ids in enumerate(docs):
        want = [
            sum(np.log1p((4 - df[t] + 0.5) / (df[t] + 0.5)) * 2.2 * (d == t).sum() / ((d == t).sum() + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(ids.tolist()))
            for d in docs
        ]
        np.testing.assert_allclose(index.scores(seed), want, rtol=1e-5)
    assert [row for row, *_ in packing.fill(docs, index)] == [0, 2, 3, 1]


def test_op7_counts_come_with_the_ids(spark, docs):
    """Document frequencies of the tasks' last rows against the ids, also with null and empty texts and copies."""
    rows = docs.select("doc_id", "text").unionByName(docs.limit(50).select("doc_id", "text")).unionByName(spark.createDataFrame([(None, None), (7, ""), (8, "a a <|endoftext|>")], "doc_id long, text string"))
    path = queries.tokenizer_path()
    table = packing.token_table(rows, path).toPandas()
    assert len(table) == rows.count()
    want = np.bincount(np.concatenate([np.unique(np.frombuffer(x, "<u2")) for x in table["ids"]]), minlength=1 << 16)
    for parts in (1, 7):
        assert (packing.document_frequency(packing.counted_tokens(rows.repartition(parts), path)) == want).all()
    assert not packing.document_frequency(packing.counted_tokens(rows.where("false"), path)).any()


def test_op7_shards_are_cut_in_few_passes(docs, monkeypatch):
    """The sample's places bound each cut, so that few passes over the keys are needed; shards stay near equal."""
    passes = []
    counts = sharding._counts
    monkeypatch.setattr(sharding, "_counts", lambda rows, probes: passes.append(len(probes)) or counts(rows, probes))
    got = packing.pack(docs, queries.tokenizer_path(), shard_tokens=100_000).toPandas()
    sizes = got.groupby(got["sequence_id"] // (1 << 32))["length"].sum()
    assert 1 <= len(passes) <= 3
    assert len(sizes) == -(-sizes.sum() // 100_000) and abs(sizes - sizes.mean()).max() <= 0.1 * sizes.mean() + 2 * got["doc_tokens"].max()


def test_op7_encoder_by_either_pattern(library):
    """Signs of white space and letters at random: the library's ids; texts in which no white space meets don't look ahead."""
    shortcut = tokens.prove(queries.tokenizer_path())
    encoder = tokens.WholeEncoder(shortcut, "<u2")
    rng = np.random.default_rng(3)
    odd = list("ab1!'s t  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u200b\u202f\u3000\u180eé中\u0301²") + ["<|endoftext|>", "\U00010400"]
    plain = list("ab1!'s t\n\t\x1c\u200b中") + ["a"] * 8
    for k in range(4000):
        text = "".join(rng.choice(plain if k % 2 else odd, int(rng.integers(0, 25))))
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    encoder.merger = None
    for text in ("one two\nthree\tfour", " it's 12 中文字 x\n", "a\x1c\x1db"):
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_op3_cuts_with_a_sample(spark):
    """Keys of a sample narrow the search; the counts of the cuts are exact and within the tolerance."""
    rows = spark.range(5000).selectExpr("cast((id * 7919) % 4999 as long) << 40 AS key", "cast(1 + id % 13 AS long) AS size")
    table = rows.toPandas()
    total = table["size"].sum()
    for first in ([], [5 << 40], [k << 40 for k in range(0, 5000, 37)], [k << 40 for k in range(4990, 6000)]):
        cuts = sharding.find_cuts(rows, 8, 0.05, first=first)
        assert len(cuts) == 7
        for k, c in enumerate(cuts, 1):
            below = table[table["key"] < c.key]
            assert (c.below_bytes, c.below_rows) == (below["size"].sum(), len(below))
            assert abs(c.below_bytes - total * k / 8) <= 0.05 * total / 8


def test_op7_shards_hold_neighbours(docs):
    """Against BM25 over all documents: copies share a shard, and so do far more of the best ten than a deal by hash gives."""
    path = queries.tokenizer_path()
    got = packing.pack(docs, path, shard_tokens=50_000).toPandas()
    shard = (got["sequence_id"] // (1 << 32)).groupby(got["doc_id"]).first()
    table = packing.token_table(docs, path).toPandas()
    ids = [np.frombuffer(x, "<u2") for x in table["ids"]]
    own = shard[table["doc_id"]].to_numpy()
    df = np.bincount(np.concatenate([np.unique(d) for d in ids]), minlength=1 << 16).astype(float)
    index = packing.Index(ids, df, len(ids), table["n"].mean(), packing.Bm25())
    met = []
    for seed in range(0, len(ids), 5):
        rank = index.scores(seed)
        rank[seed] = -1
        met.append((own[np.argsort(-rank, kind="stable")[:10]] == own[seed]).mean())
    assert len(set(own)) > 10 and np.mean(met) > 0.15
    shards = table.assign(own=own, ids=[x.tobytes() for x in ids]).groupby("ids")["own"].agg(["size", "nunique"])
    assert (shards["nunique"][shards["size"] > 1] == 1).mean() > 0.9


def test_op8_totals(spark, texts):
    got = NAMES["op8_cube_mixing"](spark, SF).toPandas()
    assert len(got) == len(texts)
    assert (got["size"] == [len(texts[d].encode().split()) for d in got["doc_id"]]).all()
    assert (got["taken"] <= 3 * got["size"]).all()
    for _, rows in got.groupby("source"):
        assert abs(rows["taken"].sum() - rows["target"].iloc[0]) <= rows["size"].max()
    again = NAMES["op8_cube_mixing"](spark, SF).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def test_op8_targets_water_filling():
    aims = mixing.targets([100, 10, 1000], [5, 2, 1])
    assert aims[0] == 300 and aims[1] == 30 and aims[2] == pytest.approx(780)
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [5, 2]) == [0, 5]


def test_op8_flight_keeps_sums():
    rng = np.random.default_rng(3)
    p, size = rng.random(900), rng.integers(0, 5000, 900).astype(float)
    out = mixing._flight(p, size)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-5) and (out * size).sum() == pytest.approx((p * size).sum(), rel=1e-7)


def test_op9_digests_and_likeness(spark, texts):
    got = NAMES["op9_weighted_fingerprints"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    ids = sorted(texts)
    true, seen = [], []
    for i, d in enumerate(ids):
        x, y = texts[d], texts[ids[(i + 1) % len(ids)]]
        m = len(x) // 4
        edited = x[: len(x) - m] + y[:m]
        assert (got.n_chars[i], got.edited_sha256[i]) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        a, b = Counter(x.lower().split()), Counter(edited.lower().split())
        true.append(sum((a & b).values()) / max(1, sum((a | b).values())))
        seen.append(got.near_edited[i])
    error = np.array(seen) - np.array(true)
    assert abs(error.mean()) < 0.02 and np.sqrt((error**2).mean()) < 0.11
    prints = {}
    for i, d in enumerate(ids):
        assert prints.setdefault(texts[d], got.fingerprint[i]) == got.fingerprint[i]
    assert len(got.fingerprint[0]) == 4 * fingerprints.SLOTS


def test_op9_slots_keep_the_standard_error():
    assert fingerprints.SLOTS >= 48  # sqrt(0.8 * 0.2 / 48) = 0.058


def _simhash(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    votes = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def test_op10_matches_brute_force(spark, texts):
    got = {r["doc_id"]: r for r in NAMES["op10_simhash_components"](spark, SF).collect()}
    fp = {d: _simhash(t) for d, t in texts.items()}
    assert all(got[d]["fingerprint"] == f"{h:016x}" for d, h in fp.items())
    kinds = np.unique(np.array(list(fp.values()), np.uint64))
    root = {int(k): int(k) for k in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in kinds:
        for o in kinds[np.bitwise_count(kinds ^ k) <= 4]:
            root[find(int(o))] = find(int(k))
    low = {}
    for d, h in fp.items():
        low[find(h)] = min(d, low.get(find(h), d))
    assert all(got[d]["component_id"] == low[find(h)] for d, h in fp.items())


def test_op10_masks_cover_the_radius():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(4)]
    rng = np.random.default_rng(0)
    assert len(masks) == 31
    for _ in range(3000):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not flips & m for m in masks)


@pytest.mark.parametrize("how", [simhash.Sketch(), simhash.similar()])
def test_op10_oversize_buckets_lose_no_link(spark, how):
    rng = np.random.default_rng(1)
    rows = set()
    for _ in range(40):
        base = rng.integers(-(1 << 62), 1 << 62, how.words)
        for _ in range(20):
            flips = np.zeros(how.bits, np.uint8)
            flips[rng.choice(how.bits, int(rng.integers(0, how.radius + 1)), replace=False)] = 1
            rows.add(tuple((base ^ np.packbits(flips).view(np.int64)).tolist()))
    table = spark.createDataFrame(sorted(rows), ", ".join(f"{c} long" for c in how.columns))
    from parlance.llm.components import connected_components

    node = simhash._node(how.columns).alias("node")
    name = {tuple(r[c] for c in how.columns): r["node"] for r in table.select(*how.columns, node).collect()}
    want = _components([np.array(r, np.int64).view(np.uint64) for r in name], how.radius)
    nodes = list(name.values())
    groups = sorted(sorted(nodes[i] for i in g) for g in want if len(g) > 1)
    for most in (100_000, 40, 3):
        found = {}
        for r in connected_components(simhash.links(table, how, most)).collect():
            found.setdefault(r["root"], []).append(r["node"])
        assert sorted(map(sorted, found.values())) == groups


def _components(fps: list[np.ndarray], radius: int) -> list[list[int]]:
    """Groups of fingerprints linked by a distance of at most ``radius``, from all pairs."""
    x = np.stack(fps)
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]).sum(axis=1) <= radius).tolist():
            root[find(i)] = find(i + 1 + j)
    out = {}
    for i in range(len(x)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def test_op10_blocks_cover_the_radius():
    how = simhash.similar()
    every = simhash.tables(how)
    assert (how.shingle, how.radius, how.blocks, len(every)) == (5, 29, 6, 186)
    rng = np.random.default_rng(0)
    for _ in range(2000):
        flips = np.zeros(how.bits, np.uint8)
        flips[rng.choice(how.bits, how.radius, replace=False)] = 1
        words = np.packbits(flips, bitorder="little").view("<u8")
        assert any(not int(words[w]) & m for w, m in every)


def test_op10_votes_are_counts():
    rng = np.random.default_rng(0)
    for n in (1, 2, 254, 255, 256, 20_000):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert (simhash._votes(h) == [int((h >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]).all()


def _near_copies() -> dict[int, str]:
    """Texts with every 60th word changed: a Jaccard similarity of about 0.85 over five words."""
    rng = np.random.default_rng(2)
    made = {}
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        made[10_000_000 + 2 * k] = " ".join(words)
        made[10_000_001 + 2 * k] = " ".join("changed" if i % 60 == 30 else w for i, w in enumerate(words))
    return made


def test_pipeline_near_copies_match_brute_force(spark, docs, texts):
    made = _near_copies()
    rows = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs.select("doc_id", "text").unionByName(rows), SF).collect()}
    every = texts | made
    how = corpus_pipeline.NEAR

    def plain(text):
        words = text.encode().lower().split()
        h = {xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), 42) for i in range(max(1, len(words) - 4))} if words else set()
        h = np.array(sorted(h), np.uint64)
        votes = [(simhash._further(h, w) if w else h) >> np.uint64(b) & np.uint64(1) for w in range(how.words) for b in range(64)]
        bits = np.array([2 * int(v.sum()) > len(h) for v in votes], np.uint8)
        return np.packbits(bits, bitorder="little").view("<u8")

    ids = list(every)
    groups = _components([plain(every[d]) for d in ids], how.radius)
    assert kept == {min(ids[i] for i in g) for g in groups}
    assert sum(d % 2 for d in kept if d >= 10_000_000) <= 12  # what one similarity of 0.85 loses to the noise of 192 bits


def test_pipeline_dense_groups_stay_linked(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join([*words[:k], f"x{k}", *words[k + 1 :]])) for k in range(300)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["doc_id"] for r in got.collect()] == [0]


def test_pipeline_stages_match_their_operators(spark, docs, texts, library):
    """Each stage of a run on the whole table against what its decisions say, on the stage's own input."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels).collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, s in scored.items() if s < 0.5}
    copies = {r["doc_id"]: r["copies"] for r in mixing.cube_mix(docs).collect()}
    assert Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()) == +Counter(copies)
    got = corpus_pipeline.run(spark, SF)
    packed = got.toPandas().sort_values(["sequence_id", "offset"])
    assert (packed.groupby("sequence_id")["length"].cumsum() - packed["length"] == packed["offset"]).all()
    assert set(packed["doc_id"]) <= set(texts) and (packed.groupby("sequence_id")["length"].sum() <= 1024).all()
    full = packed.drop_duplicates(["doc_id", "start", "ids_crc32"]).groupby("doc_id")
    assert (full["length"].sum() >= full["doc_tokens"].first()).all()


def test_op5_learned_parts_reach_the_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = neighbours.search(table, 20, 20, neighbours.Partitions(part_rows=100)).toPandas()
    assert got["n_parts"].iloc[0] == 20 and 1 < got["n_probed"].iloc[0] <= 20
    pdf = table.toPandas()
    x, ids = np.stack(pdf["embedding"]).astype(np.float64), pdf["vec_id"].to_numpy()
    hits = 0
    for q, rows in got.groupby("query_id"):
        s = (x * x[ids == q][0]).sum(axis=1)
        s[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(rows["vec_id"]))
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum()


def test_op6_matches_plain_ftrl():
    """The learner against the published update, coordinate by coordinate."""
    how = toxicity.Ftrl()
    rows = [(toxicity.features(f"{'vile' if i % 4 == 0 else 'good'} words number {i % 7} here {i % 3}"), int(i % 4 == 0)) for i in range(200)]
    z, n = Counter(), Counter()
    bias = 1 << toxicity.HASH_BITS

    def weight(i):
        if abs(z[i]) <= how.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * how.l1) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for at, label in rows:
            at = [*at.tolist(), bias]
            w = {i: weight(i) for i in at}
            g = (how.toxic_weight if label else 1.0) * (1 / (1 + np.exp(-sum(w.values()))) - label)
            for i in at:
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / how.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    number, found = toxicity.fit_rows(lambda: rows, how)
    want = {i: weight(i) for i in z if weight(i)}
    assert set(number.tolist()) == set(want)
    np.testing.assert_allclose(found, [want[i] for i in number.tolist()], rtol=1e-9)


def test_op3_slots_follow_a_plain_sort(spark, docs):
    """Shards and slots against a sort of all keys in one place."""
    got = sharding.shard_by_bytes(docs, 16).toPandas().sort_values(["shard", "slot"], kind="mergesort").reset_index(drop=True)
    want = got.sort_values(["key", "doc_id", "text_crc32", "size"], kind="mergesort")
    assert want["doc_id"].tolist() == got["doc_id"].tolist()
    ends = got.groupby("shard")["size"].sum().cumsum().to_numpy()
    goal = got["size"].sum() * np.arange(1, 17) / 16
    assert np.abs(ends - goal).max() <= max(got["size"].max(), 0.01 * got["size"].sum() / 16)
