"""The operators beside brute-force versions, and on NULLs, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from dialoglens.llm import chat, covertree, decontam, graph, jaccard, pieces, pii, quality, rans, shards, shingles, warc

DOCS = "doc_id long, text string, shard int, score double, row long, id long, `group` string"
LONG = "lorem ipsum dolor sit amet " * 20_000


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Rows that operators must survive; the columns behind the text have names that operators use inside."""
    texts = [(1, None), (2, ""), (3, "one two"), (4, "one two"), (5, LONG), (6, prose(1, 80)), (6, prose(1, 80)), (None, "no id here"), (7, " \n\t ")]
    return spark.createDataFrame([(i, t, 1, 0.5, 9, 8, "x") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- 1 -------------------------------------------------------------------------------------------------------------

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_are_those_of_the_library(documents):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r.text or "" for r in documents.collect()] + ["", " ", "  a  b ", "<s> </s> <0x41>", "\n\t\x00", "é́ 日本 😀", "x" * 3000]
    ids, lengths, agree = pieces.coder(MODEL).encode(pa.array(texts))
    found = [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
    assert set(agree.to_pylist()) == {True} and found == own.encode(texts)
    assert pieces.coder(MODEL).decode(found) == own.decode(found) == pieces.coder(MODEL).decode_flat(ids, lengths).to_pylist() == texts


def test_decoding_by_the_table():
    """Any ids, also such that no text has, decode as by the library."""
    run, draw = pieces.coder(MODEL), random.Random(2)
    for _ in range(200):
        lists = [[draw.choice([draw.randrange(32_000), draw.randrange(300)]) for _ in range(draw.randrange(6))] for _ in range(5)]
        flat = np.array([i for x in lists for i in x], np.int32)
        assert run.decode_flat(flat, np.array([len(x) for x in lists], np.int64)).to_pylist() == run.decode(lists)


def test_parity_says_what_was_compared():
    ids, lengths, agree = pieces.PieceCoder(MODEL, verify=False).encode(pa.array(["a b", "", None]))
    assert agree.to_pylist() == [None, None, None]
    assert pieces.PieceCoder(MODEL).encode(pa.array(["a  b ", "", None]))[2].to_pylist() == [True, True, True]


def test_unigram_scores_and_byte_pieces(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = pieces.UNIGRAM, True
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = True, False
    proto.normalizer_spec.escape_whitespaces = True
    proto.pieces.add(piece="<unk>", score=0, type=pieces.UNKNOWN)
    for k in range(256):
        proto.pieces.add(piece=f"<0x{k:02X}>", score=0, type=pieces.BYTE)
    for piece, score in (("▁", -3.0), ("a", -4.0), ("b", -4.5), ("ab", -5.0), ("▁a", -5.5), ("ba", -7.0), ("▁ab", -9.9), ("c", -6.0)):
        proto.pieces.add(piece=piece, score=score, type=pieces.NORMAL)
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    own = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["ab ab", "abba cab", "  ba", "abéc", ""]
    ids, lengths, agree = pieces.PieceCoder(str(path)).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == own.encode(texts) and set(agree.to_pylist()) == {True}


def test_pieces_of_odd_rows(odd_docs, no_docs):
    found = rows(pieces.round_trip(odd_docs, MODEL).select("doc_id", "n_pieces", "parity", "round_trip", F.length("text")))
    assert len(found) == 9 and all(r[2] and r[3] for r in found)
    assert {r[0]: r[1] for r in found if r[0] in (1, 2)} == {1: 0, 2: 0}
    encoded = pieces.encode_documents(odd_docs, MODEL)
    decoded = pieces.decode_documents(encoded, MODEL, ("doc_id", "parity"))
    told = {(r.doc_id, r.text or "") for r in odd_docs.collect()}
    assert {(r.doc_id, r.text) for r in decoded.collect()} == told and decoded.columns == ["doc_id", "parity", "text"]
    assert pieces.round_trip(no_docs, MODEL).count() == 0


def test_piece_ids_are_kept(spark, documents, odd_docs):
    import corpus_pipeline
    import sentencepiece
    from dialoglens.llm import queries

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for docs in (documents, odd_docs):
        wanted = sorted(((r.doc_id or 0, np.array(own.encode(r.text or ""), "<i4").tobytes(), r.text or "") for r in docs.collect()))
        assert sorted((r.doc_id or 0, bytes(r.ids), r.text) for r in corpus_pipeline.to_pieces(spark, docs, SF_DIR).collect()) == wanted
    digests = {r.doc_id: (r.n_pieces, r.ids_crc32) for r in queries.QUERIES["op1_sentencepiece"](spark, SF_DIR).collect()}
    assert digests == {r.doc_id: (len(ids := own.encode(r.text or "")), zlib.crc32(np.array(ids, "<i4").tobytes())) for r in documents.collect()}


# ---- 2 -------------------------------------------------------------------------------------------------------------

def test_chat_digests_of_marks_ties_and_nulls(spark):
    marks = "<|im_end|><|im_start|>assistant ok <\\|x <| <\\\\|"
    told = [(1, 1, "assistant", marks), (1, 0, "user", None), (1, 1, "assistant", "a"), (2, 0, "us\\er\n<|", ""), (3, 0, None, LONG), (None, 0, "user", "alone"), (None, 0, "user", "alone")]
    table = spark.createDataFrame([(*t, 1, 2) for t in told], "conv_id long, turn long, role string, text string, span int, piece int")
    turns = chat.to_turns(table, chat.layout_of(table.schema, ignore=("span", "piece")))
    found = collections.defaultdict(list)
    for conv, n, said, chars, loss, length in rows(chat.conversation_digests(chat.format_turns(turns))):
        found[conv].append((n, said, chars, loss, length))
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert found[1][0][:4] == (3, digest(f"user\n\nassistant\n{marks}\nassistant\na\n"), len(marks) + 1, digest(marks + "a"))
    assert found[2][0][:4] == (1, digest("us\\er\n<|\n\n"), 0, digest(""))
    assert found[3][0][:3] == (1, digest(f"\n{LONG}\n"), 0)
    assert len(found[None]) == 2 and found[None][0][0] == 1
    assert chat.conversation_digests(chat.format_turns(turns.limit(0))).count() == 0


def test_layouts_by_fingerprint(spark):
    import json

    records = [
        {"conv_id": 1, "prompt": "p", "response": "r"},
        {"conv_id": 2, "instruction": "i", "input": "", "output": "o"},
        {"conv_id": 3, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]},
        {"conv_id": 4, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        {"conv_id": 5, "unheard": 1},
    ]
    table = spark.createDataFrame([(json.dumps(r),) for r in records] + [("no json",), (None,)], "record string")
    turns, unknown = chat.json_turns(table)
    assert sorted((r.conv_id, r.role, r.text) for r in turns.collect()) == [
        (1, "assistant", "r"), (1, "user", "p"), (2, "assistant", "o"), (2, "user", "i"),
        (3, "system", "s"), (3, "user", "u"), (4, "assistant", "g"), (4, "user", "h"),
    ]
    assert unknown.count() == 3
    with pytest.raises(ValueError):
        chat.layout_of(spark.createDataFrame([(1, "x")], "conv_id long, song string").schema)


# ---- 3 -------------------------------------------------------------------------------------------------------------

def test_shards_are_near_equal_and_gapless(documents):
    found = shards.shard_documents(documents, 8, 512).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in found} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in texts.items()}
    loads, places = collections.Counter(), collections.defaultdict(list)
    for r in found:
        loads[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert max(loads.values()) - min(loads.values()) <= 2 * max(r["size"] for r in found)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert all(r.next_shard in (r.shard, 8) for r in found) and any(r.next_shard == 8 for r in found)


def test_rebalancing_moves_only_from_full_shards():
    draw = random.Random(3)
    sizes = [draw.randrange(1000) for _ in range(4096)]
    first = shards.first_map(sizes, 10)
    assert shards.rebalance(first, sizes, 10).owner == first.owner
    grown = shards.rebalance(first, sizes, 11)
    assert grown.version == 2 and all(b in (a, 10) for a, b in zip(first.owner, grown.owner, strict=True))
    assert max(grown.loads(sizes)) < 1.05 * sum(sizes) / 11
    fewer = shards.rebalance(first, sizes, 9)
    assert max(fewer.owner) == 8 and all(b == a for a, b in zip(first.owner, fewer.owner, strict=True) if a < 9)
    heavy = [s * (20 if o == 0 else 1) for s, o in zip(sizes, first.owner, strict=True)]
    evened = shards.rebalance(first, heavy, 10)
    assert max(evened.loads(heavy)) < 1.1 * sum(heavy) / 10


def test_shards_of_odd_rows(odd_docs, no_docs):
    found = shards.shard_documents(odd_docs, 4, 64).collect()
    assert len(found) == 9 and {r["size"] for r in found if r.doc_id in (1, 2)} == {16}
    assert len({(r.shard, r.slot) for r in found}) == 9
    assert shards.shard_documents(no_docs, 4, 64).count() == 0


# ---- 4 -------------------------------------------------------------------------------------------------------------

def test_leaks_survive_substitutions_and_spare_clean_texts(spark, odd_docs, no_docs):
    items = [(1, prose(50, 30)), (2, prose(51, 15)), (3, "too short"), (4, None), (5, prose(50, 30))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, row string")
    words = prose(50, 30).split()
    changed = [w if k % 6 else "changed" for k, w in enumerate(words)]
    texts = [
        (1, f"{prose(60, 40)} {prose(50, 30).upper()}. {prose(61, 40)}"), (2, f"{prose(62, 9)} {' '.join(changed)} {prose(63, 9)}"),
        (3, prose(51, 15)), (4, prose(64, 400)), (5, " ".join(words[:7])), (None, prose(51, 15)), (6, " ".join(words[8:22])),
    ]
    docs = spark.createDataFrame([(i, t, 1, 0.5, 9, 8, "x") for i, t in texts], DOCS).unionByName(odd_docs)
    found = {(r.doc_id, r.item_id): (r.n_matched, r.item_words, r.first_word, r.last_word) for r in decontam.contaminated(docs, benchmark).collect()}
    assert found.keys() == {(1, 1), (1, 5), (2, 1), (2, 5), (3, 2), (None, 2), (6, 1), (6, 5)}
    assert found[1, 1] == (30, 30, 40, 69) and found[2, 1][0] == 25 and found[6, 1] == (14, 30, 0, 13)
    assert found[3, 2] == (15, 15, 0, 14)
    left = decontam.without_leaks(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted(
        [(4, prose(64, 400)), (5, " ".join(words[:7])), *((r.doc_id or 0, r.text or "") for r in odd_docs.collect())]
    )
    assert decontam.contaminated(no_docs, benchmark).count() == 0
    assert decontam.contaminated(docs, benchmark.limit(0)).count() == 0


# ---- 5 -------------------------------------------------------------------------------------------------------------

def vector_links(ids, vectors, cosine=0.95):
    """Counts and components by comparing all pairs."""
    x = np.array([v / np.linalg.norm(v) for v in np.array(vectors, float)])
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    least = collections.defaultdict(lambda: 1 << 60)
    for k, i in enumerate(ids):
        least[root(k)] = min(least[root(k)], i)
    return {i: (int(linked[k].sum()), least[root(k)]) for k, i in enumerate(ids)}


def test_vector_pairs_are_exact(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 128)
    draw = np.random.default_rng(4)
    base = draw.normal(size=(300, 16))
    tight = draw.normal(size=16) + draw.normal(size=(200, 16)) * 0.03
    chain = np.array([[np.cos(t), np.sin(t), *[0] * 14] for t in np.arange(0, 3, 0.3)])
    loose = draw.normal(size=16) + draw.normal(size=(150, 16)) * 0.35
    vectors = np.concatenate([base, base[:40] + draw.normal(size=(40, 16)) * 0.05, tight, chain, loose, base[:10] * 3, base[:5]])
    vectors = vectors.astype(np.float32)
    ids = draw.permutation(len(vectors)).tolist()
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, weight int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_duplicates(table).collect()}
    assert found == vector_links(ids, vectors)


def test_vectors_that_link_with_nothing(spark):
    told = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]),
            (7, [float("inf"), 0.0]), (8, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 0.0])]
    table = spark.createDataFrame(told, "vec_id long, embedding array<float>")
    found = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(table).collect())
    assert found == [(0, 0, None, False), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *((i, 0, i, True) for i in range(3, 10))]
    assert covertree.near_duplicates(table.limit(0)).count() == 0


# ---- 6 -------------------------------------------------------------------------------------------------------------

def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    found = quality.classify(docs, labels)
    held = found.join(labels, "doc_id").filter("held_out").select("predicted", "quality", "score").collect()
    assert len(held) > 60 and np.mean([r.predicted == r.quality for r in held]) >= 0.95
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found.filter("held_out").limit(50).collect())
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in found.filter("predicted = 1").collect()}


def test_held_out_labels_are_never_learnt(spark):
    d = SF_DIR
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.fold() == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in quality.classify(docs, x).collect()} for x in (labels, turned))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-6 for k in one)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    kinds = "doc_id long, quality int, x int"
    good = spark.createDataFrame([(3, 1, 0), (4, None, 0), (99, 0, 0), (None, 0, 0)], kinds)
    found = quality.classify(odd_docs, good).collect()
    assert len(found) == 9 and all(r.score == 1.0 and r.predicted == 1 for r in found)
    mixed = spark.createDataFrame([(i, k % 2, 0) for k, i in enumerate((1, 2, 3, 4, 5, 6, 6, 7))], kinds)
    assert all(0 <= r.score <= 1 for r in quality.classify(odd_docs, mixed).collect())
    assert quality.classify(no_docs, mixed).count() == 0


def test_pooling_gives_the_isotonic_fit():
    centres, values = quality.pooled([0.0, 1.0, 2.0, 3.0], [1, 0, 2, 3], [1, 1, 2, 3])
    assert values.tolist() == [0.5, 1.0] and centres.tolist() == [0.5, 13 / 5]


# ---- 7 -------------------------------------------------------------------------------------------------------------

WORDS = public_tokenizers.path("word_bpe_49k.json")


def token_digests(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    start, out = 0, []
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()) if r[1] is not None else -1)):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_hold_what_the_tokenizer_gives(documents, odd_docs, no_docs):
    found = rows(rans.token_files(documents, WORDS, file_tokens=5000))
    assert sorted(found) == sorted(token_digests([(r.doc_id, r.text) for r in documents.collect()]))
    found = rows(rans.token_files(odd_docs, WORDS))
    assert sorted(found, key=lambda r: r[1]) == token_digests([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert rans.token_files(no_docs, WORDS).count() == 0


def test_parts_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    texts = ["don't X'S.foo a.'s b!c?'re É'LL İİ K", "é.̸x y z\x0b\x1c'", "a×b÷c, 12.5% ...\x85", "", "  ", "Áb é. ́x"]
    whole = [x.ids + [2] for x in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    ids, lengths = rans.encoder(WORDS).encode(pa.array(texts), 2)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == whole


def test_added_tokens_are_found_in_the_raw_text(spark):
    texts = ["hello <|endoftext|> world", "<|startoftext|>A B<|endoftext|>", "plain. text", "<|endoftext|>", "", None, "É<|endoftext|>\u0301x's", "<|ENDOFTEXT|> <|endoftext |>",
             "<|endoftext|>" * 3, "last"]
    docs = list(enumerate(texts))
    found = rows(rans.token_files(spark.createDataFrame(docs, "doc_id long, text string"), WORDS))
    assert sorted(found) == token_digests(docs)
    ids, lengths = rans.encoder(WORDS).encode(pa.array(texts[:1]), 2)
    assert ids.tolist() == [3306, 49407, 1002, 2] and lengths.tolist() == [4]
    ids, lengths = rans.encoder(WORDS).encode(pa.array([], pa.string()), 2)
    assert not len(ids) and not len(lengths)


@pytest.mark.parametrize("ids", [[7], [5] * 200_000, list(range(70_000)), np.random.default_rng(1).zipf(1.3, 300_000) % 49_408])
def test_rans_blocks_decode_alone(ids):
    ids = np.array(ids, np.uint32)
    data = b"".join(rans.pack_file(np.array([1]), np.array([True]), np.array([len(ids)]), ids))
    file = rans.TokenFile(memoryview(data))
    assert (file.tokens() == ids).all()
    block = file.steps * rans.LANES
    for b in range(file.blocks):
        assert (file.tokens(b, b + 1) == ids[b * block:(b + 1) * block]).all()


def test_rans_finds_damage():
    ids = np.random.default_rng(2).integers(0, 500, 50_000).astype(np.uint32)
    data = bytearray(b"".join(rans.pack_file(np.array([1]), np.array([True]), np.array([len(ids)]), ids)))
    data[-9] ^= 1
    with pytest.raises(ValueError):
        rans.TokenFile(memoryview(bytes(data))).tokens()


# ---- 8 -------------------------------------------------------------------------------------------------------------

def test_archives_and_revisits(spark):
    told = [(1, "http://a/", "x" * 1000), (5, "http://b/\r\nX: y", "x" * 1000), (3, None, "x" * 1000), (2, "u", "y" * 999), (4, "u", "y" * 999),
            (6, "u", None), (7, "u", ""), (8, "u", LONG), (None, "u", "x" * 1000), (9, "u", "é" * 600), (9, "u", "é" * 600), (None, "u", "no id")]
    pages = spark.createDataFrame([(*t, "k") for t in told], "page_id long, url string, html string, keeper string")
    found = sorted(rows(warc.archive_pages(pages, archive_bytes=5000)), key=str)
    wanted = []
    for page_id, _, html in told:
        data = (html or "").encode()
        refers = 5 if html == "x" * 1000 and page_id != 5 else None
        wanted.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers))
    assert found == sorted(wanted, key=str)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_dictionary_leads_the_archive():
    records = [warc.make_record(k, "u", f"{prose(k % 7, 150)} {k}".encode(), "00" * 20, 5, None, "d") for k in range(800)]
    data = b"".join(warc.pack_archive(records))
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert list(warc.read_archive(memoryview(data))) == records
    few = records[:3]
    assert list(warc.read_archive(memoryview(b"".join(warc.pack_archive(few))))) == few


# ---- 9 -------------------------------------------------------------------------------------------------------------

def shingle_classes(docs):
    """n_shingles and component of each document, by comparing all pairs that share a shingle."""
    sets = {}
    for doc_id, text in docs:
        data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        words = re.findall(rb"[^\x20\x09-\x0D]+", data)
        sets[doc_id] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 175 * len(sets[i] & sets[j]) >= 75 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {k: (len(sets[k]), root(k)) for k in sets}


def test_similarity_classes_are_exact(spark, documents):
    draw = random.Random(8)
    told = [(r.doc_id, r.text) for r in documents.collect()]
    base, shared = prose(70, 120).split(), prose(71, 60)
    for k in range(150):  # near copies at all distances from the threshold
        words = [w if draw.random() > 0.0008 * k / 2 else prose(k, 1) for w in base]
        told.append((10_000 + k, " ".join(words[: draw.choice((120, 110, 100, 90))])))
    for k in range(90):  # a passage that many share
        told.append((20_000 + k, f"{shared} {prose(100 + k, 5 + k)}"))
    told += [(30_000 + k, t) for k, t in enumerate(["a b c", "A b  C", "a b", "", None, "\x0b", "é b c", "a b c d e f g", "a b c d e f g h"])]
    docs = spark.createDataFrame(told, "doc_id long, text string").repartition(7)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs).collect()}
    assert found == shingle_classes(told)


def test_classes_where_everything_is_common(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON_DOCUMENTS", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    draw = random.Random(9)
    lines = [prose(200 + k, 12) for k in range(14)]
    told = [(k, "\n".join(draw.sample(lines, draw.choice((5, 6, 7))))) for k in range(160)]
    docs = spark.createDataFrame(told, "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(docs).collect()}
    assert found == shingle_classes(told)


def test_no_size_in_a_block_is_passed_over(spark):
    query, block = [*range(2, 11), 100], [list(range(11)), list(range(-1, 11)), list(range(10))]
    sets = [(5, query, 5), *((k, s, 1) for k, s in enumerate(block, 1))]
    members = [(k, len(s), s[: jaccard.prefix_length(len(s))], group, 0) for k, s, group in sets]
    assert len({*query} & {*block[0]}) == jaccard.needed(10, 11)
    found = jaccard.candidate_blocks(spark.createDataFrame(members, "id long, n long, prefix array<long>, group long, block int"))
    assert rows(found) == [(5, 1, 0)]


def test_bound_of_a_block_is_the_least_of_all_its_sizes(spark):
    def least(n, o):
        return jaccard.needed(n, o) - max(n - jaccard.prefix_length(n), o - jaccard.prefix_length(o))

    # two members, of the smallest and the largest size, share the first `met` tokens of the query's prefix
    members, wanted = [], set()
    for n in (10, 17, 24, 40):
        for low in range(-(-3 * n // 4), 4 * n // 3 + 1):
            for high in range(low, 4 * n // 3 + 1):
                for met in range(1, jaccard.prefix_length(n) + 1):
                    k = 10 * len(members)
                    tokens = [1000 * k + t for t in range(jaccard.prefix_length(n))]
                    members += [(k + 5, n, tokens, k + 5, 0), (k, low, tokens[:met], k, 0), (k + 1, high, tokens[:met], k, 0)]
                    if met >= min(least(n, o) for o in range(low, high + 1)):
                        wanted.add((k + 5, k, 0))
    found = jaccard.candidate_blocks(spark.createDataFrame(members, "id long, n long, prefix array<long>, group long, block int"))
    assert {*rows(found)} == wanted and 0 < len(wanted) < len(members) // 3


def test_classes_of_odd_rows(odd_docs, no_docs):
    found = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.similarity_classes(odd_docs).collect()))
    assert found == [(0, 1, None), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 5, 5), (6, 76, 6), (7, 0, 7)]
    kept = jaccard.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7]
    assert jaccard.similarity_classes(no_docs).count() == 0 and jaccard.one_of_each(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(5, 5), (200, 7), (200, 201), (7, 200)]
    found = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long"))))
    assert {k: v for k, v in found.items() if v != 1} == {k: 100 for k in range(100, 161)}
    assert {k for k, v in found.items() if v == 1} == {*range(1, 40), 200, 201}


def test_shingles_do_not_depend_on_the_batch():
    texts = [prose(1, 40), "", None, "x", prose(2, 5), "A B\tC\x0bd\x85e f"]
    whole = [s.tolist() for s in shingles.shingle_sets(pa.array(texts))]
    alone = [next(shingles.shingle_sets(pa.array([t], pa.string()))).tolist() for t in texts]
    sliced = [s.tolist() for s in shingles.shingle_sets(pa.array(["pad pad", *texts])[1:])]
    assert whole == alone == sliced and [len(s) for s in whole] == [36, 0, 0, 1, 1, 1]


# ---- 10 ------------------------------------------------------------------------------------------------------------

def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def feistel(a, b, mod_a, mod_b, tweak, key=pii.KEY):
    for i in range(pii.ROUNDS):
        x = b if i % 2 == 0 else a
        n = int(hashlib.sha256(f"{key}|{tweak}|{i}|{x}|{key}".encode()).hexdigest()[:15], 16)
        a, b = ((a + n) % mod_a, b) if i % 2 == 0 else (a, (b + n) % mod_b)
    return a, b


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.with_pseudonyms(docs).orderBy("doc_id").collect()]


def test_pseudonyms_keep_their_format(spark):
    values = ["4111 1111 1111 1111", "4785380592391139", "+1 (017) 555-7713", "97.51.17.173", "123-45-6789", "1999-12-31", "2/29/2024", "31.12.1850",
              "0123456789abcdef0123456789ABCDEF".lower(), "AB" * 16 + "C1D2E3F4", "x.y@mail.example.com"]
    one, again = replaced(spark, [f"say {v}, {v}!" for v in values]), replaced(spark, [f"other: {v}" for v in values])
    for value, text, other in zip(values, one, again, strict=True):
        new = other.removeprefix("other: ")
        assert new != value and text == f"say {new}, {new}!"
        if "@" not in value and "/" not in value:
            shape = lambda s: re.sub("[0-9a-fA-F]" if len(s) >= 32 else "[0-9]", "9", s)
            assert "." in value and value.count(".") == new.count(".") or shape(new) == shape(value)
    assert luhn(re.sub(r"\D", "", again[0])) and luhn(again[1].split()[-1])


def test_cards_beside_other_numbers(spark):
    plain, amex = "4111111111111111", "3782 822463 10005"
    texts = ["4111 1111 1111 1111 123", f"{plain} 12/27", f"no 2 {plain}", "12 34 4111-1111-1111-1111 1111 5", f"{plain} {plain} 7", f"1 {amex} 1234", "x 41111111 11111111 99",
             "1234 4111 1111 1111 1111 2024-02-29", f"{plain} 12/27/2027", f"{plain} 10.0.0.1", f"{plain} 123-45-6789", f"{plain} 77a", f"{plain} 123@mail.example.com",
             " ".join(["4111 1111 1111 1111 5"] * 3000)]
    new = replaced(spark, texts)
    card, short = replaced(spark, [plain, amex])
    four = [card[k:k + 4] for k in range(0, 16, 4)]
    assert card != plain and short != amex
    assert new[:7] == [f"{' '.join(four)} 123", f"{card} 12/27", f"no 2 {card}", f"12 34 {'-'.join(four)} 1111 5", f"{card} {card} 7", f"1 {short} 1234", f"x {card[:8]} {card[8:]} 99"]
    assert new[7].startswith(f"1234 {' '.join(four)} 20") and "2024-02-29" not in new[7]
    others = replaced(spark, ["12/27/2027", "10.0.0.1", "123-45-6789", "77a", "123@mail.example.com"])
    assert new[8:13] == [f"{card} {other}" for other in others] and "123@mail" not in new[12]
    assert new[13] == " ".join([f"{' '.join(four)} 5"] * 3000)
    same = ["4111 1111 1111 1112 123", "7 " * 5000, "12345678901234567890123 4", "1" * 5000, "1-" * 5000]
    found = replaced(spark, same)
    assert found[0] == same[0] and found[2:4] == same[2:4]
    assert [len(f) for f in found] == [len(t) for t in same]


def test_phones_without_separators(spark):
    texts = ["+15551234567", "+4915112345678", "+1 5551234567", "+35312345678", "+29912345", "call +15551234567."]
    new = replaced(spark, texts)
    assert all(n != t and len(n) == len(t) for n, t in zip(new, texts, strict=True))
    assert [n[:len(code)] for n, code in zip(new, ("+1", "+49", "+1 ", "+353", "+299", "call +1"), strict=True)] == ["+1", "+49", "+1 ", "+353", "+299", "call +1"]
    assert replaced(spark, ["+1555", "1+1234567", "+0123456789012345678"]) == ["+1555", "1+1234567", "+0123456789012345678"]


def test_permutations_are_those_of_the_rounds(spark):
    octets = "97.51.17.173".split(".")
    a, b = feistel(int(octets[0]) * 256 + int(octets[1]), int(octets[2]) * 256 + int(octets[3]), 65536, 65536, "ip")
    x, y = feistel(78538, 0, 10**7, 10**7, "card4")
    card = "4785380592391139"
    x, y = feistel(int(card[1:8]), int(card[8:15]), 10**7, 10**7, "card4")
    body = f"4{x:07d}{y:07d}"
    wanted = next(body + str(k) for k in range(10) if luhn(body + str(k)))
    assert replaced(spark, ["97.51.17.173", card]) == [f"{a // 256}.{a % 256}.{b // 256}.{b % 256}", wanted]


def test_small_domains_are_permuted_one_to_one(spark):
    octets = [f"10.0.{k // 200}.{k % 200}" for k in range(4000)]
    days = [str(d) for d in np.arange("1950-01-01", "1961-01-01", dtype="datetime64[D]")]
    socials = [f"{k:03d}-01-0001" for k in range(1, 900) if k != 666]
    for values in (octets, days, socials):
        new = replaced(spark, values)
        assert len(set(new)) == len(values)
        assert replaced(spark, new[:50]) != new[:50]
    assert all("1901-01-01" <= d <= "2000-12-31" for d in replaced(spark, days))


def test_what_is_no_value_stays(spark, odd_docs, no_docs):
    texts = ["4785380592391138", "300.1.2.3", "000-12-3456", "2023-02-29", "1.2.3", "version 10.2", "0" * 16, "a" * 40, "1" * 40, "n@m", "call 555-1234", None, "", "12345678901234567890123"]
    assert replaced(spark, texts) == texts
    same = pii.with_pseudonyms(odd_docs)
    assert same.columns == odd_docs.columns and sorted(map(str, rows(same))) == sorted(map(str, rows(odd_docs)))
    assert pii.with_pseudonyms(no_docs).count() == 0
    plan = same._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


# ---- queries -------------------------------------------------------------------------------------------------------

def test_queries_beside_their_sql(spark):
    from check_queries import compare, duck
    from dialoglens.llm import queries

    for name, sql in queries.CHECKS.items():
        ok, note = compare(spark, duck(SF_DIR), queries.QUERIES[name], sql, SF_DIR)
        assert ok, (name, note)


def test_every_operator_has_a_query():
    from dialoglens.llm import queries

    assert [int(re.match(r"op(\d+)_", n)[1]) for n in sorted(queries.QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))] == list(range(1, 11))


def test_no_native_operator_runs_python(documents, spark):
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    for df in (pii.with_pseudonyms(documents), decontam.seed_hits(documents, benchmark), decontam.contaminated(documents, benchmark)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
