"""The training-data operators against brute force, exact round trips and their SQL, and on odd rows."""

import base64
import hashlib
import itertools
import math
import random
import string
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dustspark.llm import ids, jaccard, lines, mixing, packing, quality, queries, secrets, simhash, syncmers, tokens, toxicity, warc

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, doc string, id string, n int, size int, copies int, "
          "ids string, place int, range int, home int, text_hash int, kept_id int, key int, a int, t string, h int, runs int")


def odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30000))
    copy = "one two three four five six seven eight nine ten"
    rows = [(1, copy, "en", "a"), (2, copy, "en", "a"), (3, "", "en", None), (4, None, None, "b"), (None, None, None, None), (None, copy, "fr", "b"),
            (5, long, "en", "a"), (6, "  \n\n \t", "de", ""), (7, "word", "en", "a"), (7, "word", "en", "a"), (8, "é ü 漢字 🙂 don't", "es", "c"), (9, "a\x00b  c \n d", "en", "b")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", "y", *[1] * 3, "z", *[2] * 7, "t", 3, 4) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    odd_rows(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 0, 1), (7, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(1, "http://a b", "x", "k"), (2, None, "x", "k"), (None, "u", "x", "k"), (3, "u", None, "k"), (4, "u", "", "k"), (5, "u", "<p>é</p>" * 40000, "k"), (5, "u", "<p>é</p>" * 40000, "k")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string, digest string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_odd_and_empty_tables(spark, odd, empty, name):
    got = queries.QUERIES[name](spark, odd).toPandas()
    if name == "op10_warc":
        assert len(got) == 7
        assert sorted(got["record_type"]) == ["response"] * 4 + ["revisit"] * 3
    elif name == "op3_packing":
        assert got["length"].sum() == sum(d["doc_tokens"] for d in got[got.start == 0].to_dict("records"))
    elif name == "op13_collocations":
        assert len(got) == 0  # no phrase of these texts occurs ten times
    else:
        assert len(got) == 12
    assert len(queries.QUERIES[name](spark, empty).toPandas()) == 0


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    for folder in (odd, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            rows = out.collect()
            if name != "packed":
                assert out.columns == docs.columns, name
            assert folder == odd or not rows


@pytest.mark.parametrize("name", list(queries.SQL))
def test_equals_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(queries.SQL[name]).df()
    key = "doc_id" if "doc_id" in want else ["lang", "rank"]
    want = want.sort_values(key).reset_index(drop=True)
    got = queries.QUERIES[name](spark, small).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False)


def test_quality_rules_and_long_repeats(spark):
    text = " ".join(["alpha beta gamma delta epsilon zeta eta theta"] * 3)
    docs = spark.createDataFrame([(1, text), (2, text.replace("gamma", "the", 1)), (3, "a b c d e f g h i j"), (4, "x #$% " * 30)], "doc_id int, text string")
    got = {r["doc"]["doc_id"]: r for r in quality.judge(quality.measure(docs)).collect()}
    assert [got[k]["n_repeat_words"] for k in (1, 2, 3)] == [24, 21, 0]
    assert got[1]["base_failed"] and "symbols" in got[4]["failed_rules"] and not got[3]["kept"]


# ---- toxicity
def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 4, 6])
    emit = rng.normal(size=lengths.sum())
    moves = (-0.7, 0.3, 1.1)
    f, b = toxicity.messages(emit, lengths, moves)
    k = 0
    for n in lengths:
        total, marked = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            s = sum(emit[k + i] for i in range(n) if y[i])
            s += sum({(0, 0): 0, (0, 1): moves[0], (1, 0): moves[1], (1, 1): moves[2]}[p] for p in zip(y, y[1:], strict=False))
            total += math.exp(s)
            marked += math.exp(s) * np.array(y)
        np.testing.assert_allclose(1 / (1 + np.exp(-(f + b)[k:k + n])), marked / total, rtol=1e-9)
        k += n


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice(["ta", "ri", "mo", "ne", "lu"]) for _ in range(3)) for _ in range(80)]
    rows = []
    for i in range(400):
        ws = [rng.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(4):
                ws[rng.randrange(60)] = rng.choice(["grawlix", "blastard", "zounds"])
        rows.append((i, " ".join(ws), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    got = toxicity.score(docs.drop("toxic"), toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))).toPandas()
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert (held.predicted == (held.doc_id % 4 == 0)).mean() > 0.97
    text = dict((r[0], r[1]) for r in rows)
    spans = [text[d][int(a):int(b)] for d, s in zip(got.doc_id, got.spans, strict=True) for a, b in (x.split(":") for x in s.split(",") if x)]
    assert spans and set(spans) <= {"grawlix", "blastard", "zounds"}


# ---- tokens, packing, files
@pytest.mark.parametrize("name", [packing.VOCABULARY, ids.VOCABULARY])
def test_pieces_give_the_ids_of_the_whole_text(name):
    e = tokens.Encoder(tokens.vocabulary(name), memo=40)
    texts = ["a  b   c", " a", "a ", "\n\n a\n b", "a \nb", "don't stop, 123 ", "<|endoftext|> a <|endoftext|>b", "a\x1c b", "é ́a", "Σας ΟΔΟΣ İx", "  ", "a\x00b \x00",
             "it's. we'll! 漢字, x, .", "end.\n\nNext,  two"] + ["".join(random.Random(k).choices(" ab.,\n'é1", k=60)) for k in range(200)]
    for t, got in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_places_every_id_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = packing.pack(docs).toPandas()
    t = tokens.Encoder(tokens.vocabulary(packing.VOCABULARY)).tokenizer
    for doc_id, text in docs.select("doc_id", "text").collect():
        want = [*t.encode(text, add_special_tokens=False).ids, 1]
        parts = got[got.doc_id == doc_id].sort_values("start")
        assert (parts.doc_tokens == len(want)).all() and parts.start.tolist() == [0, *parts.length.cumsum()[:-1]]
        assert [i for x in parts.ids for i in x] == want
        assert all(c == zlib.crc32(np.array(x, "<u4").tobytes()) for c, x in zip(parts.ids_crc32, parts.ids, strict=True))
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all()
    sizes = got.groupby("sequence_id").length.sum()
    assert all(s <= 2048 and s & (s - 1) == 0 for s in sizes)


def test_sum_of_squares_placement():
    p = packing.Packer(8)
    rng = random.Random(2)
    for k in range(300):
        s = rng.randint(1, 7)
        before = p.count.copy()
        options = []
        for h in range(8 - s + 1):
            if h and not before[h]:
                continue
            n = before.copy()
            if h:
                n[h] -= 1
            if h + s < 8:
                n[h + s] += 1
            options.append(int((n * n).sum()))
        p.place(k, 0, s)
        assert int((p.count * p.count).sum()) == min(options)
        assert all(p.count[h] == len(p.open[h]) for h in range(1, 8))


def test_codec_round_trip():
    for m in (1, 2, 5, 2049, 9000):
        q = np.random.default_rng(m).integers(0, 65536, m)
        q[m // 2:] = q[:m - m // 2]
        blocks = [q[i:i + 700] for i in range(0, m, 700)]
        coded = ids.encode_blocks(blocks)
        assert all((x == y).all() for x, y in zip(ids.decode_blocks([len(b) for b in blocks], coded), blocks, strict=True))
    repeated = np.tile(np.arange(50), 200)
    assert len(ids.encode_blocks([repeated])[0]) < len(repeated) * 2 / 10


def test_token_files(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id")
    got = ids.round_trip(docs).toPandas().sort_values("doc_id")
    t = tokens.Encoder(tokens.vocabulary(ids.VOCABULARY)).tokenizer
    start = 0
    for row, (_doc_id, text) in zip(got.itertuples(), docs.select("doc_id", "text").collect(), strict=True):
        want = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert (row.start, row.n_tokens, list(row.ids), row.ids_crc32) == (start, len(want), want, zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)


def test_damaged_block_is_refused():
    q = np.arange(500) * 7 % 1000
    coded = bytearray(ids.encode_blocks([q])[0])
    coded[40] ^= 255
    assert ids.checksum(ids.decode_blocks([500], [bytes(coded)])[0]) != ids.checksum(q)


# ---- near duplicates
def brute_components(prints):
    label = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= simhash.BUDGET
    while True:
        new = np.where(near, label[None, :], len(prints)).min(1)
        if (new == label).all():
            return label
        label = new


def brute_fingerprint(text):
    import xxhash
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    grams = [b" ".join(ws[i:i + 4]) for i in range(max(1, len(ws) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = np.array([brute_fingerprint(r.text) for r in rows], np.uint64)
    label = brute_components(prints)
    got = {r.doc_id: r for r in queries.op4_simhash(spark, small).collect()}
    for r, p, k in zip(rows, prints.tolist(), label.tolist(), strict=True):
        assert got[r.doc_id].fingerprint == f"{p:016x}" and got[r.doc_id].component_id == rows[k].doc_id
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert kept == {rows[k].doc_id for k in label.tolist()}


def test_trie_join_of_a_crowded_subtree_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_CHUNK", 64)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    prints = np.unique(np.concatenate([base[k] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (900, 5), dtype=np.uint64), axis=1) for k in range(3)]))
    frame = spark.createDataFrame(pd.DataFrame({"fp": prints.view(np.int64)}))
    found = simhash.components(simhash.linked_pairs(frame)).toPandas()
    root = dict(zip(found.node, found.root, strict=True))
    label = brute_components(prints)
    groups, got = {}, {}
    for p, k in zip(prints.view(np.int64).tolist(), label.tolist(), strict=True):
        groups.setdefault(k, set()).add(p)
        got.setdefault(root.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


# ---- line dedup
def brute_lines(texts, gram=lines.GRAM_WORDS):
    """Deleted line numbers per document (in id order), by comparing all lines directly."""
    split = [t.split("\n") for t in texts]
    count = [[len(x.encode().split()) for x in ls] for ls in split]
    end = [[next((j for j in range(i, len(c)) if sum(c[i:j + 1]) >= gram), None) for i in range(len(c))] for c in count]
    return split, count, end


def test_line_dedup(spark):
    rng = random.Random(9)
    def line(n): return " ".join("".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(n))
    passage, pair, short = line(60), [line(25), line(30), line(22)], line(6)
    texts = ["\n".join([line(30), passage, short, line(12)]), "\n".join([short, line(8), passage, line(40)]), "\n".join([line(9), *pair, line(31)]),
             "\n".join([*pair, short, line(50)]), "\n".join([line(45), short]), "\n".join([passage, passage]), line(19)]
    texts.append(texts[2])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc"]["doc_id"]: r for r in lines.mark(docs).collect()}
    assert {k: r["deleted"] for k, r in got.items()} == {0: [], 1: [2], 2: [], 3: [0, 1, 2], 4: [], 5: [0, 1], 6: [], 7: [0, 1, 2, 3, 4]}
    split, count, end = brute_lines(texts)
    for k, r in got.items():
        for i in r["deleted"]:  # every deleted line has an equal one before it that stays
            assert any(split[d][j] == split[k][i] and j not in got[d]["deleted"] for d in range(k + 1) for j in range(len(split[d])) if (d, j) < (k, i))
        assert r["text"] == "\n".join(x for i, x in enumerate(split[k]) if i not in r["deleted"])


def test_repeated_passages_of_fifty_words_go(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    left = lines.drop_repeats(docs).select(F.explode(F.split("text", "\n")).alias("line")).where(F.size(F.split("line", " ")) > 50)
    assert left.count() == left.distinct().count()
    assert lines.drop_repeats(docs).count() == docs.count()


# ---- mixing
def test_mix_follows_targets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = mixing.plan(docs).toPandas()
    source = docs.select("doc_id", "source").toPandas()
    by = plan.merge(source, on="doc_id").groupby("source").agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= 1).all() and (by.target <= 2 * by["size"]).all() and (plan.taken <= 2 * plan["size"]).all()
    assert abs(by.taken.sum() - 1.5 * by["size"].sum()) <= len(by) + 1
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(by.index))}
    level = {round(r.target / weight[s], 3) for s, r in by.iterrows() if r.target < 2 * r["size"] - 1e-6}
    assert len(level) <= 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = mixed.groupBy("source").agg(F.sum(F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))).alias("n")).collect()
    assert {r.source: r.n for r in words} == by.taken[by.taken > 0].to_dict()


def test_inverted_demand(spark):
    for slope in mixing.SLOPES:
        rows = spark.range(11).select((F.col("id") / 10).alias("u")).select("u", mixing.invert(F.col("u"), F.lit(slope)).alias("t")).collect()
        assert all(abs(r.t + slope * (r.t * r.t - r.t) - r.u) < 1e-9 for r in rows)


# ---- fingerprints
def test_syncmer_fingerprints(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op7_syncmers(spark, small).collect()}
    seen = {}
    for k, r in enumerate(docs):
        half, other = len(r.text) // 2, docs[(k + 1) % len(docs)].text
        edited = r.text[:len(r.text) - half] + other[:half]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(r.text), hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(r.text, g.fingerprint) == g.fingerprint and 0 <= g.near_next <= 1
    assert np.mean([g.near_edited for g in got.values()]) > 0.25 > 0.05 > np.mean([g.near_next for g in got.values()])


def test_syncmers_are_context_free(spark):
    rng = random.Random(3)
    ws = ["".join(rng.choices(string.ascii_lowercase, k=4)) for _ in range(40)]
    rows = spark.createDataFrame([(" ".join(ws),), (" ".join(["x", "y", *ws, "z"]),)], "t string").select(syncmers.anchors(F.col("t")).alias("a")).collect()
    assert set(rows[0].a) <= set(rows[1].a) and 8 < len(rows[0].a) < 30


# ---- secrets
def test_secret_spans():
    assert secrets.scan("token=secret : abcdefgh") == []
    assert secrets.scan('x API-KEY: "a" api_key : "abcdef12" AKIA' + "B" * 12) == [("assign", 15, 34), ("access", 36, 52)]
    assert secrets.scan("ſecret=abcdefgh1 é " + "0f" * 16)[-1] == ("hex", 19, 51)
    rng = random.Random(6)
    for _ in range(20):
        key = "".join(rng.choices(string.ascii_letters + string.digits, k=44))
        spans = secrets.scan(f"see {key} here")
        assert [s[0] for s in spans] == ["entropy"]
        assert secrets.scan(f"sha256:{key}") == []
    assert secrets.scan("antidisestablishmentarianism internationalisation 550e8400-e29b-41d4-a716-446655440000") == []


def test_random_tokens_of_each_alphabet_are_found():
    rng = random.Random(9)
    for chars in (string.ascii_lowercase + string.digits, string.ascii_uppercase + "234567", string.ascii_letters + string.digits):
        found = sum(any(s[0] == "entropy" for s in secrets.scan("see " + "".join(rng.choices(chars, k=40)) + " here")) for _ in range(300))
        assert found > 270, (chars, found)
    assert secrets.scan("internationalisationabcdefgh ANTIDISESTABLISHMENTARIANISM") == []


def test_allow_list_suppresses_its_own_characters_only():
    key, uuid = "Zk3qP9xLr7TvB2nWm8YcD4sGf6HjQ1aE", "550e8400-e29b-41d4-a716-446655440000"
    assert secrets.scan(f"{uuid}_{key}") and all(s[0] == "entropy" and s[1] >= 36 for s in secrets.scan(f"{uuid}_{key}"))
    assert [s[2] for s in secrets.scan(f"{key}example")] == [len(key)]
    assert secrets.scan(uuid) == []


def test_window_entropy_equals_recounting():
    rng = random.Random(7)
    s = "".join(rng.choices("abcdef0123456789", k=90)) + "a" * 30
    def entropy(w): return -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w))
    covered = set()
    for i in range(len(s) - secrets.WINDOW + 1):
        if entropy(s[i:i + secrets.WINDOW]) >= 3.1 - 1e-9:
            covered |= set(range(i, i + secrets.WINDOW))
    assert covered == {k for a, b in secrets.windows(s, 3.1) for k in range(a, b)}


# ---- WARC
def test_warc_round_trip_in_small_splits(spark, small, tmp_path):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    pages = pages.unionByName(pages.limit(20).withColumn("page_id", F.col("page_id") + 100000))
    archives = warc.write(pages, str(tmp_path / "w"))
    rows = pages.toPandas()
    first = rows.groupby("html").page_id.min()
    for split in (997, 1 << 20):
        got = warc.read(spark, archives, split).toPandas().set_index("page_id")
        assert len(got) == len(rows)
        for page_id, html in zip(rows.page_id, rows.html, strict=True):
            g = got.loc[page_id]
            raw = html.encode()
            assert (g.payload_bytes, g.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            if first[html] == page_id:
                assert g.record_type == "response" and bytes(g.payload) == raw
            else:
                assert g.record_type == "revisit" and g.refers_to == first[html]


def test_magic_inside_a_member_is_refused(tmp_path):
    import os
    raw = [warc.record("response", k, "u", warc.MAGIC * 5 + os.urandom(3000) + warc.MAGIC, "x", None) for k in range(4)]
    data = b"".join(raw)
    (tmp_path / "x").write_bytes(data)
    with open(tmp_path / "x", "rb") as f:
        for step in (50, 700, 5000):
            found = [m for a in range(0, len(data), step) for m in warc.members(f, a, min(a + step, len(data)), len(data))]
            assert [warc.parse(m)[0]["WARC-Record-ID"] for m in found] == [f"<urn:page:{k}>" for k in range(4)]


def test_component_rounds_have_as_many_tasks_as_links_need(spark, monkeypatch):
    chain = list(range(60))
    random.Random(5).shuffle(chain)
    rows = [(a, b) for a, b in zip(chain, chain[1:]) if a % 7 and b % 7] + [(3, 3), (9, 9), (70, 71), (71, 70)]
    label = simhash.forest(72, *(np.array(x) for x in zip(*rows)))
    links = spark.createDataFrame(rows, "a bigint, b bigint").repartition(12)
    partitions, coalesced = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = {k: spark.conf.get(k) for k in (partitions, coalesced)}
    spark.conf.set(partitions, "12")
    spark.conf.set(coalesced, "false")
    try:
        for most, tasks in ((simhash.ROUND_LINKS, 1), (8, 12)):
            monkeypatch.setattr(simhash, "ROUND_LINKS", most)
            found = simhash.components(links)
            assert {r.node: r.root for r in found.collect()} == {k: v for k, v in enumerate(label.tolist()) if k != v}
            assert found.rdd.getNumPartitions() <= tasks
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# ---- pipeline
def test_near_dedup_equals_brute_force_jaccard(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for k in range(12):  # copies with words replaced, around the least similarity, and a passage that all have
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((30, 120, 400)))] + "a passage that every document has".split()
        for _ in range(25):
            ws = list(base)
            for _ in range(rng.randrange(max(2, len(ws) // 25))):
                ws[rng.randrange(len(ws))] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(ws))
    rng.shuffle(texts)

    def grams(t):
        ws = (t or "").lower().split()
        return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    sets, label = [grams(t) for t in texts], list(range(len(texts)))
    pairs = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                pairs += 1
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert pairs > 500 and kept == set(label) and 20 < len(kept) < len(texts) - 50


def test_near_dedup_checks_the_links_of_the_trie(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(jaccard, "linked_pairs", lambda prints: asked.append(prints.count()) or simhash.linked_pairs(prints))
    same = "a " * 400  # repeats outweigh the other words in a fingerprint, but are one shingle
    one, two = (same + " ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    copy = " ".join(f"w{i}" for i in range(300))
    texts = [one, two, copy, copy + " more"]
    assert bin(simhash.fingerprint(one) ^ simhash.fingerprint(two)).count("1") <= simhash.BUDGET
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert asked and kept == [0, 1, 2]


def test_parities_bound_the_difference_and_tell_unlike_sets(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n, m, common in ((4, 5, 4), (400, 400, 395), (500, 530, 480), (400, 400, 60), (1900, 2100, 100), (9000, 8000, 0)):
        ids = rng.integers(-2**63, 2**63 - 1, n + m, dtype=np.int64)
        x, y = np.unique(ids[:n]), np.unique(ids[n - common:n - common + m])
        rows.append((n + m, n + m - 2 * common, jaccard.parities(x).tolist(), jaccard.parities(y).tolist()))
    found = spark.createDataFrame(rows, "total int, apart int, x array<bigint>, y array<bigint>").withColumn("differ", jaccard._differ("x", "y")).collect()
    assert all(r.differ <= r.apart for r in found)
    assert [9 * r.differ <= r.total for r in found] == [True, True, True, False, False, False]


def test_pipeline_equals_its_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, small).cache()
    judged = {r.doc_id: r.kept for r in queries.op1_quality_rules(spark, small).collect()}
    assert {r.doc_id for r in kept.collect()} == {k for k, v in judged.items() if v}
    out = corpus_pipeline.run(spark, small).toPandas()
    deduped = corpus_pipeline.near_dedup(spark, corpus_pipeline.line_dedup(spark, kept, small), small)
    mixed = corpus_pipeline.source_mix(spark, deduped, small).toPandas()
    t = tokens.Encoder(tokens.vocabulary(packing.VOCABULARY)).tokenizer
    assert out.length.sum() == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in mixed.text)
    assert set(out.doc_id) == set(mixed.doc_id)
