"""Operators on small tables: brute force, and nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import random
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from trajecta.llm import near_dedup
from trajecta.llm.ann import nearest
from trajecta.llm.common import connected_components, dense_rank_slots, shared_path
from trajecta.llm.decontamination import find_contamination
from trajecta.llm.language_id import identify, train as train_languages
from trajecta.llm.licenses import FULL_TEXTS, TEMPLATES, scan_licenses
from trajecta.llm.near_dedup import near_duplicates
from trajecta.llm.packing import pack_documents
from trajecta.llm.sharding import assign_shards
from trajecta.llm.token_binary import SHARD_SCHEMA, ShardReader, read_token_shards, write_token_shards
from trajecta.llm.token_counts import apply_edits, attach_edits, build_trees
from trajecta.llm.toxicity import score_toxicity, train as train_toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, length int, score string, n_tokens string, component_id string"
WORDS = "stone river light under seven bright cloud walk hill green open door paper chair early night storm water glass bread".split()


def table(spark, rows):
    """documents with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, 7, 7, "x", "x", "x") for i, t in rows], SCHEMA)


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    out = [(i, prose(rnd, rnd.randint(3, 120))) for i in range(60)]
    base = prose(rnd, 150).split()
    for i in range(60, 100):  # copies near and less near to each other
        own = list(base)
        for _ in range(rnd.randint(0, 12)):
            own[rnd.randrange(len(own))] = rnd.choice(WORDS).upper()
        out.append((i, " ".join(own)))
    out += [(i, "the same text in many rows of the table here") for i in range(100, 130)]
    out += [(130, None), (131, ""), (132, " \t\n"), (133, "one"), (134, "ONE"), (135, prose(rnd, 6000)), (None, "a text without an id"), (7, out[7][1]), (7, out[7][1] + " more")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def key(x):
    return (x is None, x)


def test_near_duplicates_match_brute_force(docs, rows):
    got = near_duplicates(docs).collect()
    sets = [near_dedup.shingle_set(near_dedup.word_hashes((t or "").encode())[0]) for _, t in rows]
    live = [k for k, (i, _) in enumerate(rows) if i is not None and len(sets[k])]
    parent = {rows[k][0]: rows[k][0] for k in live}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in live:
        for b in live:
            if a < b and near_dedup.linked(sets[a], sets[b], 80):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[y] = x
    want = sorted(((i, len(s), root(i) if i in parent and i is not None else i, (root(i) if i in parent else i) == i or i is None) for (i, _), s in zip(rows, sets, strict=True)), key=lambda r: (key(r[0])[0], r[0] or 0, r[1]))
    have = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=lambda r: (key(r[0])[0], r[0] or 0, r[1]))
    assert have == want


def test_near_duplicates_large_bucket_goes_in_blocks(spark):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(420):
        own = list(base)
        for at in rnd.sample(range(200), rnd.randint(1, 9)):
            own[at] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    found = near_duplicates(table(spark, rows), star_rounds=0).toPandas()
    starred = near_duplicates(table(spark, rows)).toPandas()
    one, two = (x.sort_values("doc_id").component_id.tolist() for x in (found, starred))
    assert one == two


def test_near_duplicates_of_nothing(empty):
    assert near_duplicates(empty).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_slots_are_gapless(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("g"))
    out = dense_rank_slots(df, ["g"], ["id"], "slot", rows_per_bucket=20).toPandas()
    for _, part in out.groupby("g"):
        assert sorted(part.slot) == list(range(len(part)))


def test_token_shards_round_trip(spark, docs, rows, empty):
    plain = Tokenizer.from_file(PATH)
    path = shared_path(spark, "t")
    write_token_shards(docs, path, PATH, 2, shard_tokens=900)
    got = read_token_shards(spark, path).toPandas().sort_values("start")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (i, t) in zip(got.itertuples(), want, strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert (i is None and r.doc_id != r.doc_id) or r.doc_id == i
        start += len(ids)
    shard = spark.read.schema(SHARD_SCHEMA).parquet(path).first()
    reader = ShardReader(shard.symbol_bytes, shard.alphabet, shard.rules, shard.rule_lengths, shard.sequence)
    assert (reader.tokens(3, 50) == reader.all()[3:50]).all()
    write_token_shards(empty, other := shared_path(spark, "t"), PATH)
    assert read_token_shards(spark, other).count() == 0


def test_packing(docs, rows, empty):
    plain = Tokenizer.from_file(PATH)
    got = pack_documents(docs, PATH, 64, 0).toPandas()
    sizes = sorted(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert got.length.sum() == sum(sizes) and got.length.max() <= 64
    assert (got[got.piece > 0].length == 64).all()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 64
    assert got.sequence_id.nunique() <= 1.1 * sum(sizes) / 64 + 2
    long_doc = got[got.doc_id == 135].sort_values("piece")
    assert long_doc.start.tolist() == [0, *long_doc.length.cumsum().tolist()[:-1]]
    assert pack_documents(empty, PATH, 64).count() == 0


def test_sharding(docs, rows, empty):
    got = assign_shards(docs, 8).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(rows) and sizes.max() - sizes.min() <= 1
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    texts = {zlib.crc32((t or "").encode()): len((t or "").encode()) + 1 for _, t in rows}
    assert all(texts[c] == n for c, n in zip(got.text_crc32, got["size"], strict=True))
    assert got[got.n_links == 29].shard.nunique() <= 3  # 30 rows of one text; a shard holds 17
    assert assign_shards(empty, 8).count() == 0


def test_sharding_brings_evenly_split_groups_together(spark):
    texts = [f"pair {i // 2}" for i in range(400)] + [f"four {i // 4}" for i in range(200)] + [f"alone {i}" for i in range(400)]
    got = assign_shards(table(spark, list(enumerate(texts))).repartition(5), 8).toPandas()
    assert got.groupby("shard").size().tolist() == [125] * 8
    spread = got[got.n_links > 0].groupby("text_crc32").agg(n=("shard", "size"), shards=("shard", "nunique"))
    assert len(spread) == 250 and (spread[spread.n == 2].shards == 1).mean() > 0.97 and (spread[spread.n == 4].shards == 1).mean() > 0.95


def test_licences(spark, empty):
    rows = [(1, TEMPLATES["MIT-text"].upper().replace(",", " ;")), (2, "a line of prose here\nReleased under the MIT License!\nmore"), (3, "no licence at all in this text"), (4, None), (5, ""), (None, TEMPLATES["GPL-3.0"]), (2, "again some more words of prose\nreleased under the mit license")]
    got = {(r.doc_id, r.license_id): r for r in scan_licenses(table(spark, rows)).collect()}
    assert set(got) == {(1, "MIT-text"), (2, "MIT"), (None, "GPL-3.0")}
    assert got[1, "MIT-text"].whole_text and got[1, "MIT-text"].dice == 1.0 and not got[2, "MIT"].whole_text and got[2, "MIT"].n_units == 2
    assert scan_licenses(empty).count() == 0


def test_licences_in_runs_of_lines_and_words(spark):
    rnd = random.Random(8)
    around = lambda x: f"Notes on stones and rivers\n{prose(rnd, 400)}\n{x}\n{prose(rnd, 400)}"
    wrapped = lambda x: "\n".join(textwrap.wrap(x, 70))
    rows = [(1, around(wrapped(TEMPLATES["MIT-text"]))), (2, around("# " + wrapped(TEMPLATES["Apache-2.0-header"]).replace("\n", "\n# "))), (3, around("As was said. " + TEMPLATES["CC-BY-SA-4.0"] + " So it is.").replace("\n", " "))]
    rows += [(4, around(FULL_TEXTS["BSD-2-Clause-full"])), (5, FULL_TEXTS["BSD-3-Clause-full"]), (6, "Copyright (c) 2020\n" + FULL_TEXTS["Apache-2.0-full"]), (7, around(wrapped(TEMPLATES["MIT-text"])[:400])), (None, around(wrapped(TEMPLATES["ISC-text"])))]
    rows += [(8, around(wrapped(TEMPLATES["MIT-text"])) + "\n" + around(wrapped(TEMPLATES["ISC-text"])))]
    got = {(r.doc_id, r.license_id): r for r in scan_licenses(table(spark, rows)).collect()}
    want = {(1, "MIT-text"), (2, "Apache-2.0-header"), (3, "CC-BY-SA-4.0"), (4, "BSD-2-Clause-full"), (5, "BSD-3-Clause-full"), (6, "Apache-2.0-full"), (None, "ISC-text"), (8, "MIT-text"), (8, "ISC-text")}
    named = {(2, "Apache-2.0"), (6, "Apache-2.0")}  # by the first line of the notice
    assert set(got) == want | named and all(got[k].dice > 0.95 and got[k].n_units == 1 for k in want)
    assert {k for k, r in got.items() if r.whole_text} == {(5, "BSD-3-Clause-full"), (6, "Apache-2.0-full")}


def test_decontamination_in_blocks(spark, docs, empty):
    item = "glass bread storm water early night paper chair open door hill green walk cloud bright seven"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "nowhere to be found in any of these texts at all")], "item_id long, text string")
    rows = [(1, f"Before: {item.upper()}, after."), (2, item.replace("paper", "papyr").replace("hill", "hil")), (3, item[:40]), (4, None), (5, ""), (None, item)]
    for block in ({"block_items": 1}, {"block_items": 100}, {"block_chars": 60}):
        got = {(r.doc_id, r.item_id, r.distance) for r in find_contamination(table(spark, rows), bench, **block).collect()}
        assert {(d, i) for d, i, _ in got} == {(1, 1), (2, 1), (None, 1)} and (1, 1, 0) in got
    assert find_contamination(empty, bench).count() == 0 and find_contamination(docs, bench.limit(0)).count() == 0


def test_language(spark, empty):
    rnd = random.Random(5)
    kinds = {"xx": "abcdef", "yy": "ghijkl", "zz": "mnopqü"}
    make = lambda a: " ".join("".join(rnd.choice(a) for _ in range(rnd.randint(2, 7))) for _ in range(40))
    lab = spark.createDataFrame([(make(a), k) for k, a in kinds.items() for _ in range(40)] + [(None, "xx"), ("abc", None)], "text string, lang string")
    model = train_languages(lab, per_lang=30)
    rows = [(i, make(a)) for i, a in enumerate(kinds.values())] + [(3, None), (4, "12 !!"), (5, ""), (None, make("abcdef")), (6, make("rstuvw") * 3), (7, make("ghijkl") * 300)]
    got = {r.doc_id: r for r in identify(table(spark, rows), model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 4, 5, None, 7)] == ["xx", "yy", "zz", "und", "und", "und", "xx", "yy"]
    assert not any(got[i].rejected for i in (0, 1, 2, None, 7)) and all(got[i].rejected for i in (3, 4, 5, 6))
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = identify(table(spark, rows), train_languages(lab.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"} and identify(empty, model).count() == 0


def test_language_probabilities_sum_to_one():
    from trajecta.llm.language_id import ORDER, codes_of, fit_models, letters_only

    model = fit_models({"a": [letters_only("abba cab bac abcab")], "b": [letters_only("dda bad dab")]})
    letters = " abcd"
    for context in (" abc", "bbbb", "dab "):
        p = sum(np.exp(model.score(codes_of("")[:0].tolist() and codes_of("") or np.array([ord(c) for c in context + x], dtype=np.uint64))[0]) for x in letters)
        assert (p < 1.0001).all() and (p > 0.7).all() and ORDER == 5  # the rest is kept for unseen codes


def test_toxicity(spark, empty):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 8 == 0
        words = prose(rnd, 40).split()
        if toxic:
            words[rnd.randrange(40)] = rnd.choice(["vilest", "rotter", "Knave"])
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (2, 1, None), (10**9, 0, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = train_toxicity(table(spark, rows), lab)
    odd = [(5000, None), (5001, ""), (None, "you rotter"), (5002, "stone " * 20000 + "vilest")]
    got = {r.doc_id: r for r in score_toxicity(table(spark, rows + odd), model).collect()}
    right = sum(got[i].predicted == (i % 8 == 0) for i in range(900))
    assert right >= 890 and got[5002].predicted == 1 and got[5000].predicted == got[5001].predicted == 0 and got[None].predicted == 1
    none = train_toxicity(table(spark, rows), lab.limit(0))
    assert sum(r.predicted for r in score_toxicity(table(spark, rows), none).collect()) == 0 and score_toxicity(empty, model).count() == 0


def test_token_counts_under_edits(spark, docs, rows, empty):
    plain = Tokenizer.from_file(PATH)
    one_each = dict((i, t) for i, t in rows if i is not None and i != 7)
    trees = build_trees(docs.where("doc_id is null or doc_id <> 7"), PATH)
    edits = [(i, s, (i * 13 + 5 * s) % 50, s * 4, f" new{s} ") for i in one_each if i % 2 for s in range(3)] + [(0, 0, None, None, None)]
    table_ = spark.createDataFrame(edits, "doc_id long, seq int, start int, length int, replacement string")
    got = {r.doc_id: r for r in apply_edits(attach_edits(trees, table_), PATH, keep_state=True).collect()}
    assert set(got) == {*one_each, None}
    for i, text in one_each.items():
        want = text or ""
        assert got[i].n_tokens == len(plain.encode(want, add_special_tokens=False).ids)
        for _, _, start, length, new in sorted(e for e in edits if e[0] == i and e[4]):
            start = min(start, len(want))
            want = want[:start] + new + want[start + length :]
        assert got[i].text == want and got[i].n_tokens_after == len(plain.encode(want, add_special_tokens=False).ids) == sum(got[i].segment_tokens)
    assert got[135].encoded_chars < 2000  # of 40,000
    assert apply_edits(attach_edits(build_trees(empty, PATH), table_), PATH).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 8)).astype(np.float32)
    x[700:1100] = x[700]  # a very common vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5001, [0.0] * 8, 1), (5002, [None] + [1.0] * 7, 1), (5003, [float("nan")] * 8, 1), (5004, [float("inf")] * 8, 1), (5005, [1.0] * 3, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = nearest(df, df.where("vec_id % 20 = 0"), 20, leaf_rows=32, group_rows=150).toPandas()
    assert sorted(set(got.query_id)) == list(range(0, 1500, 20))
    d, hit = x.astype(np.float64), 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        s = (d * d[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -np.round(s, 12)))[:20]
        hit += len(set(want) & set(part.vec_id))
        assert part["rank"].tolist() == list(range(1, 21)) and q not in set(part.vec_id)
        assert np.allclose(part.score, s[part.vec_id]) and (np.diff(part.score) <= 0).all()
    assert hit / (75 * 20) >= 0.9
    assert nearest(df.limit(0), df.limit(0)).count() == 0
    assert nearest(df.where("vec_id < 3"), df.where("vec_id = 0"), 20).count() == 2


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(240):
        words = prose(rnd, 60).split()
        if i % 9 == 0:
            words[5] = words[20] = "vilest"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 9 == 0)))
    item = "the quick brown fox jumps over the lazy dog while seven other foxes sleep in the barn"
    rows += [(300, rows[1][1]), (301, rows[2][1] + " tail"), (302, None), (303, "42"), (304, prose(rnd, 30) + " " + item + " " + prose(rnd, 20)), (1, rows[1][1])]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(out := f"{tmp_path}/{k}")
        docs = spark.read.parquet(out)
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    ids = sorted(i for i, _ in rows)
    assert seen[0] == [i for i in ids if i not in (302, 303)]
    assert seen[1] == [i for i in seen[0] if i >= 240 or i % 9]
    assert seen[2] == sorted(set(seen[1]) - {300, 301})
    assert seen[3] == [i for i in seen[2] if i != 304]
    assert sorted(set(seen[4])) == seen[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_decontaminate_stage_goes_by_rows(spark, tmp_path):
    item = "the quick brown fox jumps over the lazy dog while seven other foxes sleep in the barn"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "so " + item), (None, "a clean text"), (5, item + " end"), (5, "another clean text"), (6, None)]
    got = corpus_pipeline.decontaminate(spark, table(spark, rows), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "a clean text"), (5, "another clean text"), (6, "")]


def test_pipeline_on_empty_tables(spark, tmp_path, empty):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[1:]:  # the first gives nothing already
        assert stage(spark, empty, str(tmp_path)).count() == 0
