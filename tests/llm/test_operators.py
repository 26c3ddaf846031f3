"""Operators against brute force, exact round trips and held-out accuracy, with edge cases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import byte_bpe, dac, dedup, html_text, leaders, lines, mixing, near, oracle, pii, quality, queries, topk
from shelfmark.llm.common import BATCH_BYTES, BATCH_KEY, arrow_map, table
from shelfmark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, row string"
EDGE = [(5, None), (6, ""), (7, " \n\t"), (8, "a b c d e f"), (9, "a  b c\nd e f"), (10, "one"), (None, "a b c d e f"), (11, "x" * 30_000), (8, "a b c d e f"), (12, "Ünï cödé 漢字 and 😀 more")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 6 else "s", 0, "clash", "clash", "clash") for i, t in EDGE], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_matches_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = c.execute(oracle.ORACLE[name])
    columns = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(cur.fetchall())


# Byte-level BPE


def encoding():
    return byte_bpe.codec().base


def test_joins_are_exact_at_every_leaf_size(docs):
    texts = [t[:2000] for t in list(docs.values())[:25]] + ["", "a", "don't  \n\n x'll''s", "  \t \n", "漢字" * 40, "é" * 99, "x" * 700, "a b c  d", "1234 5678\r\n9", "'" * 9 + "re " * 9]
    for leaf in (1, 2, 3, 7, 64):
        codec = byte_bpe.codec(leaf=leaf)
        for t in texts:
            assert codec.encode(t) == encoding().encode_ordinary(t)
            assert codec.decode(codec.encode(t)) == t.encode()


def test_random_texts_join(docs):
    draw, signs = random.Random(3), " \n\t'stlea.,1é漢 "
    codec = byte_bpe.codec(leaf=2)
    for _ in range(400):
        t = "".join(draw.choices(signs, k=draw.randrange(60)))
        assert codec.encode(t) == encoding().encode_ordinary(t)


def test_byte_bpe_query(spark, sf, docs):
    for r in queries.op3_byte_bpe(spark, sf).collect():
        ids = encoding().encode_ordinary(docs[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()


# Directly addressable codes


def test_codes_give_random_access():
    draw = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint32), np.array([0, 255, 256, 65535, 65536, 2**32 - 1], np.uint32), draw.integers(0, 50_000, 5000).astype(np.uint32)):
        cuts = [len(values) // 3, len(values) - len(values) // 3]
        shard = dac.Shard(dac.write_shard([None, 7], cuts, values))
        assert [shard.codes[i] for i in range(len(values))] == values.tolist()
        assert shard.document(1).tolist() == values[cuts[0] :].tolist() and shard.doc_ids == [None, 7]


def plain_ids(text):
    t = dac.words(dac.VOCABULARY).tokenizer
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_words_match_the_library():
    for t in ["A.'s. a'll B's%c 'tis", "x\ty\r\nz", "È²½ª º", "Ωμέγας ΣΑΣ", "", "  ", " é a%́", "don''t'llx", "ﬁ İx Ǆ", "it’s naïve", "<|endoftext|> q"]:
        assert np.frombuffer(dac.words(dac.VOCABULARY).encode(t), "<u4").tolist() == plain_ids(t)[:-1]


def test_added_tokens_as_a_fresh_tokenizer_finds_them(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path(dac.VOCABULARY))
    texts = ["a <|endoftext|> b <|startoftext|>c", "x<|ENDOFTEXT|>y", "<|endoftext|>", "a <| b |> <|endoftext", "é 漢字<|startoftext|>\n<|endoftext|>'s", "plain < | words", "it's 5 <b>"]
    assert fresh.encode(texts[0], add_special_tokens=False).ids == [320, 49407, 321, 49406, 322]
    start, want = 0, []
    for i, t in enumerate(texts):
        ids = [*fresh.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, dac.read_documents(dac.write_documents(df)).collect())) == want


def test_token_files_query(spark, sf, docs):
    start = 0
    for r in queries.op4_token_files(spark, sf).orderBy("doc_id").collect():
        ids = plain_ids(docs[r["doc_id"]])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_shards_close_at_a_bound(spark, edge):
    shards = dac.write_documents(edge, shard_ids=3)
    read = dac.read_documents(shards)
    assert shards.count() > 3 and read.count() == len(EDGE)
    rows = sorted(read.collect(), key=lambda r: r["start"])
    assert rows[0]["doc_id"] is None and [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows[:-1])]).tolist()


def test_one_token_is_read_from_storage(spark, sf, docs):
    shards = dac.write_documents(table(spark, sf, "documents"), shard_ids=20_000)
    want = [i for k in sorted(docs) for i in plain_ids(docs[k])]
    rows = shards.select("part", "seq", "first", "n_tokens").orderBy("part", "seq").collect()
    start = 0
    for r in rows[:: max(1, len(rows) // 3)]:
        start = sum(x["n_tokens"] for x in rows[: rows.index(r)])
        codes = dac.one_shard(shards, r["part"], r["seq"]).codes
        for at in (0, r["n_tokens"] // 2, r["n_tokens"] - 1):
            assert codes[at] == want[start + at]
    import glob

    import pyarrow.parquet as pq

    column = pq.ParquetFile(glob.glob(f"{shards._shelfmark_path.removeprefix('file:')}/*.parquet")[0]).metadata.row_group(0).column(5)
    assert (column.path_in_schema, column.compression) == ("shard", "UNCOMPRESSED")


def test_one_id_on_many_rows_is_split(spark):
    rows = [(7, f"text number {k % 50} of one id") for k in range(3000)] + [(k, "other") for k in (1, 9)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = dac.write_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.select("part").distinct().count() > 2
    got = sorted(dac.read_documents(shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [1, *[7] * 3000, 9]


def test_other_vocabularies_go_through_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("Upper and lower", "  two  spaces\n", "é漢"):
        assert np.frombuffer(dac.words("byte_bpe_50k.json").encode(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids


# Quality


def test_quality_on_held_out(spark, sf):
    scored = {r["doc_id"]: r for r in queries.op2_quality(spark, sf).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in table(spark, sf, "labels").collect()]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in scored.items())
    held = [(scored[i]["predicted"], y) for i, y in labels if scored[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_quality_without_labels(spark, edge):
    none = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    assert {(r["score"], r["predicted"]) for r in quality.quality_scores(edge, none).collect()} == {(0.5, 1)}


def test_pairwise_ranking_against_plain_steps():
    """Weights against gradient steps over all pairs, the threshold against every cut."""
    draws = np.random.default_rng(4)
    x = draws.normal(size=(60, 3)) * [1, 5, 0.2] + [3, 0, 1]
    label = ((x - [3, 0, 1]) @ [1.0, -0.3, 2.0] + draws.normal(size=60) > 0).astype(int)
    model = quality.fit(x, label, pairs=200_000, penalty=1e-3)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    d = (z[label == 1][:, None, :] - z[label == 0][None, :, :]).reshape(-1, 3)
    w = np.zeros(3)
    for _ in range(20_000):
        w += 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 1e-3 * w)
    assert np.allclose(model.weights, w, rtol=0.05, atol=0.02)
    raw = model.raw(x)
    wrong = lambda cut: np.mean(raw[label == 0] >= cut) + np.mean(raw[label == 1] < cut)
    assert wrong(model.threshold) <= min(wrong(c) for c in raw) + 0.02
    assert ((model.scores(x) >= 0.5) == (raw >= model.threshold)).all()


def test_labels_and_ids_that_repeat_fit_once(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    first = quality.train(docs, labels)
    again = quality.train(docs.unionByName(docs), labels.unionByName(labels))
    assert np.array_equal(first.weights, again.weights) and first.threshold == again.threshold


# Mixing


def test_targets_fill_like_water(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 700, None: 40, "e": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    order = [*sorted(x for x in sizes if x is not None), None]
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(order)}
    want, capped, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        rest = [x for x in order if x not in capped]
        share = {x: left * weight[x] / sum(weight[y] for y in rest) for x in rest}
        over = [x for x in rest if share[x] > 2 * sizes[x]]
        if not over:
            break
        for x in over:
            want[x] = 2.0 * sizes[x]
            capped.add(x)
            left -= want[x]
    want |= share
    assert all(abs(got[x] - want[x]) < 1e-6 for x in sizes)


def test_mix_bounds_and_reruns(spark, edge):
    rows = mixing.mix(edge).collect()
    assert len(rows) == len(EDGE) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(edge).collect()))
    assert mixing.mixed_documents(edge).columns == edge.columns


# Top-k


def brute_top(vectors, asked, k):
    out = set()
    for q in asked:
        best = sorted(((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block", [3, 1000])
def test_top_k_with_ties_and_gaps(spark, block):
    draw = random.Random(5)
    raw = [(i, [draw.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(24)]) for i in range(300)] + [(900, None), (901, [float("nan")] * 24), (902, [None] * 24), (903, [float("inf")] * 24), (904, [0.1]), (920, [0.2]), (940, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in raw], "vec_id long, embedding array<float>, score string")
    vectors = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in raw if v is not None and not any(x is None or not np.isfinite(x) for x in v)}
    got = {tuple(r) for r in topk.top_k(df, df["vec_id"] % 20 == 0, query_block=block).collect()}
    assert got == brute_top(vectors, [i for i in vectors if i % 20 == 0], 20)


# Exact copies


def test_exact_groups_edges(spark, edge):
    rows = dedup.exact_groups(edge).collect()
    by = {}
    for r in rows:
        by.setdefault(r["text_sha256"], []).append(r)
    assert len(rows) == len(EDGE) and all(sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)} for g in by.values())
    same = by[hashlib.sha256(b"abcdef").hexdigest()]
    assert {r["keep_id"] for r in same} == {9} and len(same) == 4
    kept = dedup.drop_exact_copies(edge)
    assert kept.columns == edge.columns and kept.count() == len(by)


def test_a_tiny_filter_lets_all_through(spark, sf):
    docs = table(spark, sf, "documents")
    few = dedup.exact_groups(docs, most_bits=64).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, queries.op7_exact_dedup(spark, sf).select(few.columns).collect()))


# Near copies


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)] + [(7, 7)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got.get(x, x) == find(x) for x in root)


def brute_near(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in texts}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_near_components(spark, width, percent):
    draw, texts = random.Random(width), {}
    words = [f"w{i}" for i in range(30)]
    for group in range(4):
        base = [draw.choice(words) for _ in range(draw.choice((4, 25, 60)))]
        for _ in range(25):
            copy = [draw.choice(words) if draw.random() < 0.02 * group else w for w in base]
            texts[len(texts)] = " ".join(copy[draw.randrange(2) :])
    texts |= {500: None, 501: "", 502: "one", 503: "ONE", 504: "two words", 505: " \n"}
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, class string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_components(df, width, percent).collect()}
    assert got == brute_near(texts, width, percent)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_near_components_of_a_large_group(spark, width, percent):
    """Copies with changes of their own, many too far from one another to link, and one set with very many copies."""
    draw, texts = random.Random(7 * width), {}
    base = [f"w{draw.randrange(900)}" for _ in range(130)]
    for i in range(160):
        copy = list(base)
        for _ in range(draw.randrange(1, 9)):
            at = draw.randrange(len(copy))
            copy[at : at + draw.randrange(2)] = [f"own{i}x{draw.randrange(9)}" if draw.random() < 0.7 else draw.choice(base)] * draw.randrange(1, 3)
        texts[3 * i + 1] = " ".join(copy)
    want = brute_near(texts, width, percent)
    copies = {10_000 + i: texts[1] for i in range(3000)}
    df = spark.createDataFrame(list((texts | copies).items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_components(df, width, percent).collect()}
    assert got == want | dict.fromkeys(copies, want[1])
    assert 1 < len({c for _, c in want.values()}) < len(texts)


def test_differences_from_a_centre_decide_as_whole_sets_do(spark):
    draw, percent = random.Random(8), 80
    base = set(range(100))
    sets = {i: (base - set(draw.sample(range(100), draw.randrange(14)))) | {draw.randrange(1000, 1060) for _ in range(draw.randrange(14))} for i in range(120)}
    led = [(0, i, len(s), sorted(s ^ sets[0])) for i, s in sets.items() if i]
    rows = leaders.centred(spark.createDataFrame(led, "leader long, class long, n int, diff array<long>"), percent)
    sure = {tuple(r) for r in leaders.certain(rows).collect()}
    like = lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    assert sure and all(like(a, b) for a, b in sure)
    got = {tuple(sorted(r)) for r in leaders.inside(rows, spark.createDataFrame([], "node long, component long"), percent).collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def joined(links):
        for i in sets:
            root[i] = i
        for a, b in links:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return [find(i) for i in sets]

    assert all(like(a, b) for a, b in got)
    assert joined(sure | got) == joined({(a, b) for a in sets for b in sets if 0 < a < b and like(a, b)})


def test_near_copies_go_by_row(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long), (2, long + " end"), (2, "something quite unlike the first of them all"), (None, long + " other"), (None, "a null id of its own that stays"), (3, ""), (3, ""), (4, None), (5, "Twice the same here"), (5, "Twice the same here"), (6, "y" * 50_000 + " tail")]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, digest string, row string")
    kept = near.drop_near_copies(df)
    assert kept.columns == df.columns
    want = [rows[0], rows[2], *rows[4:9], rows[10]]
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame(want, "doc_id long, text string").collect()))
    got = [r["component_id"] for r in near.near_components(df.filter("doc_id is null"), 5, 80).collect()]
    assert got == [None, None]
    assert near.drop_near_copies(df.limit(0)).collect() == []


# Lines


def brute_lines(texts):
    first, out = {}, {}
    keyed = sorted(((i is None, i or 0, lines.text_key(t)), i, t) for i, t in texts)
    for key, i, t in keyed:
        for k, c in enumerate(lines.chunks(t)):
            if lines.removable(c):
                first.setdefault(b"\n".join(c), (key, k))
    for key, i, t in keyed:
        kept = [c for k, c in enumerate(lines.chunks(t)) if not lines.removable(c) or first[b"\n".join(c)] == (key, k)]
        out.setdefault(i, []).append(b"\n".join(x for c in kept for x in c).decode())
    return out


def test_lines_against_brute_force(spark):
    draw = random.Random(4)
    passages = [[f"line {p} {k} of a passage" for k in range(14)] for p in range(5)]
    texts = [(0, None), (1, ""), (2, "\n\n\n"), (3, "a")]
    for i in range(10, 60):
        own = [f"own {i} {k}" for k in range(draw.randrange(9))]
        texts.append((i, "\n".join(own + draw.choice(passages) + own[::-1] + draw.choice(passages))))
    texts += [(200, texts[-1][1]), (200, texts[-1][1])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, hash string")
    got = {}
    for r in lines.dedup_lines(df).collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
        assert r["n_lines"] == (dict(texts)[r["doc_id"]] or "").count("\n") + 1
    want = brute_lines(texts)
    assert got == want and sum(len(x) for v in got.values() for x in v) < 0.5 * sum(len(t or "") for _, t in texts)


def brute_runs(texts):
    """Texts without the lines that stood beside the same line with text earlier; rows in the operator's order."""
    seen, out = {}, {}
    for i, t in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0, lines.text_key(x[1]))):
        row, held = (i, t), (t or "").split("\n")
        gone = set()
        for a in range(len(held)):
            b = next((k for k in range(a + 1, len(held)) if held[k].strip()), None)
            if held[a].strip() and b is not None:
                at = seen.setdefault(tuple(held[a : b + 1]), (row, a, b))
                if at != (row, a, b):
                    gone |= set(range(a, b + 1)) - (set(range(at[1], at[2] + 1)) if at[0] == row else set())
        out.setdefault(i, []).append(("\n".join(x for k, x in enumerate(held) if k not in gone), len(gone)))
    return out


def test_short_runs_of_lines_go(spark, tmp_path):
    draw = random.Random(6)
    runs = [[f"run {p} {k} of some words" for k in range(2 + p % 4)] for p in range(12)]
    texts = [(0, None), (1, ""), (2, "\n\n\n"), (3, "a"), (4, "x\nx\nx\nx"), (5, "p\n\nq\n \nr"), (6, "0\np\n\nq\n1\nq\n \nr"), (7, "x y\nalone"), (8, "alone\nz"), (None, "p\n\nq")]
    for i in range(20, 90):
        own = [f"own {i} {k}" for k in range(draw.randrange(4))]
        texts.append((i, "\n".join(own + draw.choice(runs) + own[::-1] + draw.choice(runs) + ["alone"] * draw.randrange(2))))
    texts += [(200, texts[-1][1]), (200, texts[-1][1])]
    spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, hash string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in queries.op9_line_dedup(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["n_removed"]))
        assert r["n_lines"] == (dict(texts)[r["doc_id"]] or "").count("\n") + 1
    want = brute_runs(texts)
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert got[4] == [("x\nx", 2)] and got[6] == [("0\n1", 6)] and got[8] == [("alone\nz", 0)] and got[None] == [("", 3)]
    assert {x for _, t in texts for x in (t or "").split("\n")} == {x for v in got.values() for t, _ in v for x in t.split("\n")} | {" "}
    assert not any(set(r) <= set(t.split("\n")) for r in runs for t, _ in got[200])


# Personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(text):
    def good(kind, found):
        d = re.sub("[^0-9]", "", found)
        return kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in found.split("."))) or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)

    return [f"{k}:{x.start()}:{x.end()}" for k, p in PLAIN.items() for x in re.finditer(p, text or "") if good(k, x[0])]


TRICKY = ["a@b.co_x@y.z 1.2.3.4.5.6.7.8 256.1.1.1", "😀 4111 1111 1111 1111 x 4111-1111-1111-1112", "+1 (487) 555-7209 +12 3", "9" * 9000, "0001.2.3.255 a@b a@b.c-d.", "+1 2 3.4.5.6 7@8.9", "4111 1111 1111 1111 2", "", None, "é" * 50 + "x@y.zz", "--+33 1 23 45 67 89-- 1-2-3-4-5-6-7-8-9-0-1-2-8"]


def test_base_spans(spark, docs):
    texts = dict(enumerate(TRICKY)) | {i + 100: t for i, t in list(docs.items())[:150]}
    draw = random.Random(1)
    texts |= {10_000 + i: "".join(draw.choices("01239. -+@ab()", k=60)) for i in range(400)}
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, base_email string")
    for r in pii.digest(pii.find_personal_data(df)).collect():
        want = brute_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert set(want) <= set(r["spans"].split(",") if r["spans"] else [])


PLANTED = {
    "email": ["write to {} (at) site{} (dot) com", "my mail: {} [at] host{}[dot]org", "contact {} at mail{} dot net"],
    "phone": ["please call (487) 555-7{:03d}{} now", "phone 487-555-2{:03d}{}", "tel. 0049 30 12{:03d}67{}"],
    "ip": ["login from 10[.]20[.]{}[.]7{}", "server 192 . 168 . {} . 1{}", "host 2001:db8:0:0:1:2:{}:9{}"],
}
#: Like personal data, but not: checks that fail, and numbers of other things.
UNLIKE = ["order 4111.1111.1111.{:04d}", "version 300.{}.12.999", "serial 9999 8888 7777 {:04d}", "chapter 12[.]999[.]{}[.]300", "meet at noon dot {}", "+12 {}", "isbn 978-0-306-{:05d}-7 1", "room 1234.5678.{:04d}.0001"]


def planted(n=40):
    """Texts with the span each has beyond the base patterns, if any."""
    out = []
    for i in range(n):
        for kind, forms in PLANTED.items():
            text = forms[i % len(forms)].format(*((f"jo{i}", i) if kind == "email" else (i, "")))
            start = re.search(r"jo[0-9]|\(487|487-|0049|10\[|192 |2001:", text).start()
            out.append((f"words {text}", f"{kind}:{start + 6}:{len(text.removesuffix(' now')) + 6}"))
        out.append((f"4111 1111 1111 1111 and a{i}@b.com, 10.0.0.{i}, +1 (212) 555-01{i % 90 + 10}", None))
        out += [(f"the {form.format(i)} here", None) for form in UNLIKE]
    return out


def test_spans_beyond_the_base_are_found(spark):
    rows = planted()
    df = spark.createDataFrame([(k, t, "clash") for k, (t, _) in enumerate(rows)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: set(filter(None, r["spans"].split(","))) - set(brute_spans(rows[r["doc_id"]][0])) for r in pii.digest(pii.find_personal_data(df)).collect()}
    want = {k: {s} if s else set() for k, (_, s) in enumerate(rows)}
    hits = sum(len(got[k] & want[k]) for k in got)
    assert hits >= 0.9 * sum(map(len, want.values())), [(rows[k][0], got[k], want[k]) for k in got if got[k] != want[k]][:9]
    assert hits >= 0.95 * sum(map(len, got.values())), [(rows[k][0], got[k], want[k]) for k in got if got[k] - want[k]][:9]
    assert pii.estimate({}) == {}


def test_failed_checks_are_voted_on(spark, sf):
    spans = pii.with_spans(table(spark, sf, "documents"))
    failed = spans.selectExpr("explode(concat(more_card, more_ip, more_phone)) as s").select("s.found", "s.told.*").collect()
    assert failed and all(r["check"] == r["sound"] * 2 - 1 for r in failed)
    kept = pii.digest(pii.find_personal_data(table(spark, sf, "documents"))).collect()
    assert sum(len(r["spans"].split(",")) - sum(r[f"n_{k}"] for k in pii.KINDS) for r in kept if r["spans"]) <= sum(r["sound"] for r in failed)


# Pages

PAGE = """<!DOCTYPE html><html><head><title>Head &amp; title</title><script>var t="</p><p>no</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
<main><article><h1>The&nbsp;  headline</h1><p>First <b>bold</b>text &lt;here&gt;<br>next <!-- no --> line<p>Second, unclosed &eacute;.
<aside class="sidebar">Side words</aside><ul><li>item one<li>item two</ul><form><input><button>Send</button></form>
<section class="comments"><p>A reader comment of many words that must not be taken as text.</p></section></article></main>
<footer>&copy; nobody</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "The headline First boldtext <here> next line Second, unclosed é. item one item two"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    long = "word " * 40
    plain = f"<div><a href=x>a</a> <a href=y>b</a></div><div>{long}</div><div>{long}</div><div><a href=z>links here</a></div>"
    assert html_text.main_text(plain) == (long + long).strip()
    assert html_text.main_text("<p>a < b <3 &amp;amp; </ p>x") .startswith("a < b")


ARTICLE = "<p>" + " ".join(f"w{i}" for i in range(40)) + "</p><p>" + " ".join(f"v{i}" for i in range(22)) + "</p>"
LAYOUTS = [
    '<div class="layout has-sidebar"><article>{}</article></div>', '<div class="no-sidebar">{}</div>', '<div class="no-sidebar"><article>{}</article></div>', '<div class="social-science">{}</div>', '<article><div class="social-science">{}</div></article>',
    '<div class="related-work"><article>{}</article></div>', '<article><section class="related-work">{}</section></article>', '<div id="search-results-page">{}</div>', '<form id="aspnetForm"><nav><a href=x>a b</a></nav>{}<footer>c</footer></form>',
    '<main><div class="entry-content comments-open">{}</div></main>', '<div class="page sidebar-left"><main>{}</main></div>', '<div class="comments"><article class="comment"><p>I think so too, said a reader.</p></article></div><article>{}</article>',
    '<main>{}<form><label>Name</label><p>Leave your address for the weekly letter.</p></form></main>', '<header class="page-header"><h1>The site</h1><p>Tag line</p></header><div>{}</div>', '<div class="cookie-banner"><p>We use cookies to make this site better for all.</p></div><div role="main">{}</div>',
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_names_round_the_article_do_not_empty_the_page(layout):
    want = ARTICLE[3:-4].replace("</p><p>", " ")
    page = layout.format(ARTICLE)
    assert html_text.main_text(page) == want
    around = f'<html><body><header><h1>Site</h1></header><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>{page}<div class="comments"><p>{"words of a reader " * 25}</p></div><footer>foot</footer></body></html>'
    assert html_text.main_text(around) == want


@pytest.mark.parametrize(("left", "least"), [(list(range(7, 10)), 0.7), (list(range(7, 12)), 0.7)])
def test_a_tree_without_names_still_classifies(spark, sf, left, least):
    """Trees grown without what tags and names tell, and without the main element too; words, links and neighbours do the rest."""
    x, y = html_text.labelled()
    x[:, left] = 0
    tree = html_text.grow(x, y)
    assert (html_text.classified(x, tree) == (y > 0)).mean() > 0.85
    right = total = 0
    for r in table(spark, sf, "pages").collect():
        found = html_text.blocks(r["html"])
        v = html_text.vectors(found)
        v[:, left] = 0
        right += (html_text.classified(v, tree) == [b.main for b in found]).sum()
        total += len(found)
    assert right > least * total


def test_deep_pages_take_time_in_proportion():
    import time

    began, n = time.time(), 100_000
    assert html_text.main_text("<div>" * n + "hello there " * 9 + "</div>" * n) == ("hello there " * 9).strip()
    html_text.main_text("<p><table>" + "<div class=ad>" * n + "x" + "</p>" * n)
    assert time.time() - began < 4


def test_pages_of_any_kind(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (None, None, None, "clash"), (2, "v", "", "clash"), (3, None, "<article>" + "<p>long text " * 60_000, "clash")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == sorted((i or 0, len(html_text.main_text(h))) for i, _, h, _ in rows)


def test_pages_query(spark, sf):
    pages = {r["page_id"]: r for r in table(spark, sf, "pages").collect()}
    for r in queries.op1_main_text(spark, sf).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]]["html"], re.S)[1]
        want = " ".join(html_text.html.unescape(re.sub(r"</?(?:p|br|h1)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), pages[r["page_id"]]["url"])


# All


def test_empty_tables(spark, edge):
    none, vectors = edge.limit(0), spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages, labels = spark.createDataFrame([], "page_id long, url string, html string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = [
        html_text.extract_pages(pages), quality.quality_scores(none, labels), byte_bpe.digests(byte_bpe.decode_documents(byte_bpe.encode_documents(none))), dac.read_documents(dac.write_documents(none)), mixing.mix(none),
        topk.top_k(vectors, vectors["vec_id"] % 20 == 0), dedup.exact_groups(none), near.near_components(none), lines.dedup_lines(none), pii.digest(pii.find_personal_data(none)),
    ]
    assert [df.count() for df in found] == [0] * 10


def test_edge_rows_run_everywhere(spark, edge):
    assert byte_bpe.digests(byte_bpe.decode_documents(byte_bpe.encode_documents(edge))).count() == len(EDGE)
    assert near.near_components(edge).count() == len(EDGE)
    assert lines.dedup_lines(edge).count() == len(EDGE)
    assert pii.digest(pii.find_personal_data(edge)).count() == len(EDGE)


def test_one_pass_round_trip(spark, sf, edge):
    for some in (edge, table(spark, sf, "documents")):
        apart = byte_bpe.digests(byte_bpe.decode_documents(byte_bpe.encode_documents(some)))
        assert sorted(map(str, byte_bpe.digests(byte_bpe.round_trip(some)).collect())) == sorted(map(str, apart.collect()))


def test_exact_copies_of_a_hot_text(spark):
    rows = [(i if i % 7 else None, "hot text" if i % 3 == 0 else f"text {i // 2}") for i in range(300)] + [(3, "hot text"), (3, "hot text"), (500, "hot  text"), (501, "hot  text")]
    groups = {}
    for i, text in rows:
        groups.setdefault(text.replace(" ", ""), []).append((-len(text), i is None, i))
    kept = dedup.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["text"].replace(" ", ""), r["doc_id"] or -1) for r in kept) == sorted((key, min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2] or -1) for key, g in groups.items())


def test_batches_for_python_are_bounded_in_bytes(spark):
    texts = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text"))  # 12 MB in one task

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    spark.conf.unset(BATCH_KEY)
    try:
        for bound in (BATCH_BYTES, 300_000):  # the second is the session's own and stays
            got = arrow_map(texts, sizes, "n long, size long").collect()
            assert sum(r["n"] for r in got) == 600 and max(r["size"] for r in got) <= bound + 50_000
            spark.conf.set(BATCH_KEY, "300000")
        assert spark.conf.get(BATCH_KEY) == "300000"
    finally:
        spark.conf.unset(BATCH_KEY)
