"""The training-data operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiscalens.llm import egojoin, langid, linededup, mixing, ngram_join, rangecoder, sentencepieces, sharding, tokenfiles, warc
from fiscalens.llm.fertility import op9
from fiscalens.llm.shared import WORD, new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(WORD)


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuéß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n", " "]) for _ in range(k))
    rows = []
    for i in range(n):
        rows.append((i, text(rng.choice([1, 3, 8, 40, 120])), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "hot", "hot", None]), 1))
    base = text(150).split(" ")
    for i in range(12):
        copy = base[:]
        copy[rng.randrange(len(copy))] = f"edit{i}"
        rows.append((100 + i, " ".join(copy), "en", "hot", 1))
    long = text(30_000)
    rows += [(200, None, "en", "a", None), (201, "", None, None, 0), (202, "   \n\t", "de", "b", 5), (203, long, "en", "hot", 1), (204, long, "en", "hot", 1)]
    rows += [(205, base and " ".join(base), "en", "a", 1), (205, " ".join(base), "en", "a", 1), (None, "a null id b c d e", "en", "a", 1), (206, "▁ é🎉 日本語　x   y <|endoftext|>", "en", "z", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


def rows(df):
    return [r.asDict() for r in df.collect()]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_jump_hash_and_slots(spark, docs):
    def jump(key, n):
        key &= (1 << 64) - 1
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * float(1 << 31) / float((key >> 33) + 1))
        return b

    ids = [0, 1, -1, 7, 2**63 - 1, -(2**63), 123456789, *range(1000, 1100)]
    df = spark.createDataFrame([(i,) for i in ids], "k long")
    for n in (1, 2, 16, 17, 100, 257, 5000):
        assert all(r.s == jump(r.k, n) for r in df.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect())
    out = rows(sharding.op1(docs.withColumn("_bucket", F.lit(1)).withColumn("shard", F.lit(9))))
    assert len(out) == len(corpus())
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = {r["doc_id"]: r for r in out}
    assert by[200]["size"] == 1 and by[200]["text_crc32"] == 0
    assert sharding.op1(empty(spark)).count() == 0


def test_mixing(spark, docs):
    out = rows(mixing.op3(docs))
    size = Counter()
    for _, text, _, source, _ in corpus():
        size[source] += len(WORDS.findall(text or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(size.values())
    while True:
        level = rest / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 2 * size[s]]
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            rest -= target[s]
            free.discard(s)
        if not free:
            break
    source = {i: s for i, _, _, s, _ in corpus()}
    taken = Counter()
    for r in out:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
        assert r["source_size"] == size[source[r["doc_id"]]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - target[s]) < 1 for s in order)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["taken"], r["shards"])
    assert sorted(out, key=key) == sorted(rows(mixing.op3(docs.repartition(3))), key=key)
    mixed = mixing.mixed_documents(docs, [5.0, 2.0, 1.0])
    words = sum(len(WORDS.findall(r["text"])) for r in rows(mixed))
    assert mixed.columns == docs.columns and words == sum(taken.values())
    assert mixing.op3(empty(spark)).count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("_n", "size", "target", "shard", "fp", "_key", "_pass")})
    assert sorted(map(str, out)) == sorted(map(str, rows(mixing.op3(clash))))
    blocks = rows(mixing.mixed_blocks(docs, [5.0, 2.0, 1.0], block=32, shards=5))
    assert sum(r["n_words"] for r in blocks) == words and all(len(WORDS.findall(r["text"])) == r["n_words"] <= 32 for r in blocks)
    assert len({(r["source"], r["slot"]) for r in blocks}) == len(blocks)


def test_shards_draw_their_blocks(spark):
    slots = {"a": 6000, "b": 3000, None: 999, "c": 1}
    df = spark.createDataFrame(list(slots.items()), "source string, slots long")
    shards, total, seen = 10, sum(slots.values()), []
    for seed in (1, 2):
        found = rows(mixing.shard_counts(df, shards, seed))
        by = defaultdict(dict)
        for r in found:
            by[r["source"]][r["shard"]] = (r["first"], r["slots"])
        assert {s: sum(n for _, n in x.values()) for s, x in by.items()} == slots
        for s, x in by.items():
            upto = 0
            for shard in sorted(x):
                assert x[shard][0] == upto
                upto += x[shard][1]
            share = slots[s] / total
            assert all(abs(x.get(k, (0, 0))[1] - slots[s] / shards) <= 5 * (total / shards * share * (1 - share)) ** 0.5 + 1 for k in range(shards))
        seen.append({(r["source"], r["shard"]): r["slots"] for r in found})
        assert seen[-1] == {(r["source"], r["shard"]): r["slots"] for r in rows(mixing.shard_counts(df.repartition(3), shards, seed))}
    assert seen[0] != seen[1]


def test_permutation_is_one():
    for n in (1, 2, 5, 64, 1000):
        at = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 77, np.uint64))
        assert sorted(at) == list(range(n))


@pytest.mark.parametrize(("n", "block"), [(1, 64), (64, 64), (65, 64), (3000, 300)])
def test_range_coder_round_trip(n, block):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50257).astype(np.int32)
    for x, width in ((ids, 16), (np.where(rng.random(n) < 0.2, rng.integers(0, 2**31 - 1, n), ids).astype(np.int32), 31), (np.zeros(n, np.int32), 1)):
        words, sizes = rangecoder.encode(x, block, width)
        assert (rangecoder.decode(words, sizes, n, block, width) == x).all()


def test_range_coder_of_many_ids_and_blocks():
    rng = np.random.default_rng(3)
    for n, block, width in ((150_000, 4096, 31), (70_000, 300, 17)):
        x = rng.integers(0, 1 << width, n).astype(np.int32)
        words, sizes = rangecoder.encode(x, block, width)
        assert (rangecoder.decode(words, sizes, n, block, width) == x).all()


def test_range_coder_nears_the_entropy_of_ids_without_order():
    p = 1 / np.arange(1, 2001)
    p /= p.sum()
    x = np.random.default_rng(4).choice(2000, 40_000, p=p).astype(np.int32) * 25
    words, _ = rangecoder.encode(x, 2048, 16)
    assert 16 * len(words) / len(x) < 1.12 * -(p * np.log2(p)).sum()


def test_range_coder_predicts_what_follows_over_all_blocks():
    rng = np.random.default_rng(8)
    n, distinct = 100_000, 900
    after, jump, free = rng.permutation(distinct), rng.random(n) < 0.1, rng.integers(0, distinct, n)
    x = np.zeros(n, np.int32)
    for i in range(1, n):
        x[i] = free[i] if jump[i] else after[x[i - 1]]
    words, sizes = rangecoder.encode(x, 256, 16)
    assert (rangecoder.decode(words, sizes, n, 256, 16) == x).all()
    assert 16 * len(words) / n < 2.2  # 1.5 bits of entropy and the ends of blocks; no block is long enough to learn this


def test_words_are_chunks_without_what_stands_behind():
    import public_tokenizers
    import pyarrow as pa

    behind = [".", ",", "!?", ".\nThe", ";\n\nA", "-b", "'s", "\u00e9,", "\u00d7,", "\u00a0.", "<|endoftext|>", "<|", "|>", ",\u3000x", ".\n", "\n x", "9."]
    texts = ["".join(f" w{chr(97 + k % 26)}{chr(97 + k // 26)}{b}" for k in range(400)) for b in behind] + ["a.", ".", "\n", "a\nb", "\na", "b\n", "", None, ",a\n", "\n,a", "x \ny"]
    tokenizer, sent = tokenfiles._Tokenizer(public_tokenizers.path("byte_bpe_50k.json"), False), []
    joined = tokenizer.joined
    tokenizer.joined = lambda found: sent.extend(found) or joined(found)
    ids, sizes = tokenizer.ids(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in tokenizer.model.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sum(x.startswith(b" w") for x in sent) == 400 * 10  # words alone, and with each of the nine before which none may be cut off


def test_chunks_of_one_slot_stay_known_beside_each_other(monkeypatch):
    from fiscalens.llm import chunks

    monkeypatch.setattr(chunks, "word_hashes", lambda data, start, end: data[start].astype(np.uint64) << np.uint64(1))  # all on slot 0
    asked = []
    known = chunks.Chunks(lambda found, _: asked.extend(found) or (np.array([x[0] for x in found], np.int32), np.ones(len(found), np.int64)))
    for text in (b"a", b"b", b"ab", b"c", b"bc", b"cb", b"a"):
        data = np.frombuffer(text, np.uint8)
        assert known.ids(data, np.array([0, len(data)]), np.arange(len(data)))[0].tolist() == list(text)
    assert asked == [b"a", b"b", b"c", b"a"]


def test_new_chunks_go_to_the_tokenizer_together():
    import public_tokenizers
    import pyarrow as pa

    texts = ["".join(f"{(' ', '  ', chr(10) + ' ', ' ' + chr(0xA0), ' <', '<|endoftext|> ')[k % 60 if k % 60 < 6 else 0]}w{k * j}" for k in range(300)) for j in range(1, 8)] + ["", None, " ", "x", "  y ", "é à\t z"]
    tokenizer, sent = tokenfiles._Tokenizer(public_tokenizers.path("byte_bpe_50k.json"), False), []
    batch = tokenizer.batch
    tokenizer.batch = lambda found, **options: sent.extend(found) or batch(found, **options)
    ids, sizes = tokenizer.ids(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in tokenizer.model.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert len(sent) < 40


def test_most_of_many_chunks_stay_known():
    from fiscalens.llm import chunks

    asked = []
    known = chunks.Chunks(lambda found, _: asked.append(len(found)) or (np.zeros(len(found), np.int32), np.ones(len(found), np.int64)))
    data = np.frombuffer(b"".join(b" %07d" % k for k in range(700_000)), np.uint8)
    for _ in range(2):
        known.ids(data, np.array([0, len(data)]), np.arange(0, len(data), 8))
    assert asked[0] == 700_000 and asked[1] < 350_000


def test_segments_notice_damage():
    image = tokenfiles.pack(np.array([1, 2]), np.zeros(2, bool), np.array([3, 2]), np.arange(5, dtype=np.int32), 2)
    assert tokenfiles.unpack(image)[3].tolist() == [0, 1, 2, 3, 4]
    for at in (40, len(image) - 1):
        broken = bytearray(image)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            tokenfiles.unpack(bytes(broken))


def test_token_files(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = defaultdict(list)
    for i, text, *_ in corpus():
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        expected[i].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    out = rows(tokenfiles.op4(docs))
    assert all((r["n_tokens"], r["ids_crc32"]) in expected[r["doc_id"]] for r in out) and len(out) == len(corpus())
    start = 0
    for r in sorted(out, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"])):
        assert r["start"] == start
        start += r["n_tokens"]
    assert tokenfiles.op4(empty(spark)).count() == 0
    path = new_folder(spark, "t")
    tokenfiles.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), segment=1000, block=64)
    back = {r["doc_id"]: r["ids"] for r in rows(tokenfiles.read_token_ids(spark, path))}
    assert back[206] == model.encode(next(t for i, t, *_ in corpus() if i == 206)).ids


def test_chunks_of_one_hash_are_noticed(spark, docs, monkeypatch):
    from fiscalens.llm import chunks

    def same(data, start, end):
        return np.full(len(start), 5, np.uint64)

    import public_tokenizers
    import pyarrow as pa

    texts = pa.array(["one two three", "x y  z", "", None, "<|endoftext|> a b"])
    path = public_tokenizers.path("byte_bpe_50k.json")
    expected = [list(e.ids) for e in tokenfiles._Tokenizer(path, False).model.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
    pieces = sentencepieces.Pieces(sentencepieces.default_model(), 0.1, 7)
    keys = np.arange(5, dtype=np.uint64)
    alone = [pieces.encode_alone((t or "").encode(), int(k)).tolist() if t else [] for t, k in zip(texts.to_pylist(), keys, strict=True)]
    found, sizes = pieces.encode(texts, keys)
    assert [x.tolist() for x in np.split(found, np.cumsum(sizes)[:-1])] == alone
    monkeypatch.setattr(chunks, "word_hashes", same)
    ids, sizes = tokenfiles._Tokenizer(path, False).ids(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == expected


def test_sentence_pieces(spark, docs):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    texts = {i: t or "" for i, t, *_ in corpus()}
    for r in rows(sentencepieces.encode_pieces(docs, dropout=0.0)):
        if r["doc_id"] not in (None, 206):
            assert r["ids"] == own.encode(texts[r["doc_id"]])
    out = rows(sentencepieces.op2(docs))
    assert all(r["lossless"] and r["n_ids"] == len(r["ids"]) for r in out)
    assert sum(r["n_ids"] for r in out) > sum(len(own.encode(t)) for t in texts.values())
    assert sorted(map(str, out)) == sorted(map(str, rows(sentencepieces.op2(docs.repartition(2)))))
    decoded = {r["doc_id"]: r["text"] for r in rows(sentencepieces.decode_pieces(sentencepieces.op2(docs)))}
    assert decoded == texts
    turns = {r["doc_id"]: r["ids"] for r in rows(sentencepieces.encode_pieces(docs.withColumn("turn", F.lit(2)), turn="turn"))}
    first = {r["doc_id"]: r["ids"] for r in out}
    assert turns[203] != first[203] and turns[201] == first[201] == []
    assert sorted(map(str, out)) == sorted(map(str, rows(sentencepieces.op2(docs.withColumns({"ids": F.lit("x"), "turn": F.lit("y"), "lossless": F.lit(0)})))))
    assert sentencepieces.op2(empty(spark)).count() == 0


def test_rounds_find_the_best_candidates_without_sorting(monkeypatch):
    model = sentencepieces.Pieces(sentencepieces.default_model(), 0.1, 7)
    words = [f" {w}{k}" for k in range(200) for w in ("international", "aaaaaaaaaa", "x", "Straße", "unconstitutional")]
    sorted_rows, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or lexsort(keys))
    ids, sizes = model._together([w.encode() for w in words], np.arange(len(words)))
    assert sum(sorted_rows) <= sum(map(len, words))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [model.by_heap(w.encode(), k) for k, w in enumerate(words)]


def test_merge_agenda_by_heap_equals_rounds():
    model = sentencepieces.Pieces(sentencepieces.default_model(), 0.3, 5)
    words = [b" thering", b"  x", "éàüß".encode(), b" nonononononon", "日本語".encode(), b" a"] * 4
    variants = np.arange(len(words)) % 5
    ids, sizes = model._together(words, variants)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [model.by_heap(w, int(v)) for w, v in zip(words, variants, strict=True)]
    assert len({tuple(model.by_heap(b" nonononononon", v)) for v in range(5)}) > 1


def test_each_occurrence_has_its_own_merges(spark):
    data = [(i, "the nonononono " * 500) for i in range(8)]
    out = rows(sentencepieces.encode_pieces(spark.createDataFrame(data, "doc_id long, text string"), dropout=0.1))
    model = sentencepieces.Pieces(sentencepieces.default_model(), 0.1, 20240101)
    data, at = np.frombuffer((" " + "the nonononono " * 500).encode(), np.uint8), np.array([0, 15 * 500 + 1])
    cuts = sentencepieces.space_cuts(data, at)
    places = np.random.default_rng(1).integers(0, 2**62, len(cuts))
    raw, ends = data.tobytes(), [*cuts[1:].tolist(), len(data)]
    found = [model.by_heap(raw[a:b], int(p)) for a, b, p in zip(cuts.tolist(), ends, places, strict=True)]
    for _ in range(2):  # with new and with known trees
        assert model.paths.ids(data, at, cuts, places)[0].tolist() == [i for x in found for i in x]
    assert len({tuple(x) for x in found[1::2]}) > 8
    plain = len(model._together([b" the"], np.array([-1]))[0])
    varied = [len(model.by_heap(b" the", int(p))) > plain for p in places]
    assert 0.05 < np.mean(varied) < 0.5
    assert all(r["lossless"] for r in out) and len({tuple(r["ids"]) for r in out}) == 8


def vectors(spark):
    rng = np.random.default_rng(2)
    out = [(i, rng.normal(size=8).tolist()) for i in range(150)]
    for i in range(40):
        out.append((300 + i, (np.array(out[i % 3][1]) + rng.normal(size=8) * 0.25).tolist()))
    out += [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [1.0, None] * 4), (504, []), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (507, [1e300, 1.0]), (508, [1e300, 2.0])]
    out += [(0, out[0][1]), (509, out[5][1]), (None, out[5][1])]
    return out, spark.createDataFrame(out, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("interval", [8192, 16])
def test_embedding_links(spark, monkeypatch, interval):
    monkeypatch.setattr(egojoin, "INTERVAL", interval)
    monkeypatch.setattr(egojoin, "LEAF", min(interval, 64))
    data, df = vectors(spark)

    def usable(v):
        return bool(v) and None not in v and all(np.isfinite(v)) and any(v)

    n = len(data)
    links = defaultdict(set)
    for i in range(n):
        for j in range(i):
            a, b = data[i][1], data[j][1]
            if usable(a) and usable(b) and len(a) == len(b):
                a, b = np.array(a) / np.max(np.abs(a)), np.array(b) / np.max(np.abs(b))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                    links[i].add(j)
                    links[j].add(i)
    key = lambda x: (x is not None, x or 0)
    expected = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((data[j][0] for j in seen), key=key)
        expected.append((data[i][0], len(links[i]), least, data[i][0] == least))
    got = [tuple(r) for r in egojoin.op5(df.repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert egojoin.op5(df.where("false")).count() == 0


def test_warc_round_trip(spark):
    big = "x" * 500
    pages = [(i, f"http://h/{i} a\r\nb", big if i % 3 == 0 else f"page {i} é " * 20) for i in range(1, 30)]
    trap = "a" * 100 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    pages += [(50, None, None), (51, "u", ""), (52, "u", "short"), (53, "u", "short"), (54, "u", trap), (55, "u", trap * 40), (56, None, trap)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload_bytes", F.lit(0)).repartition(4)
    first = {}
    for i, _, html in pages:
        first.setdefault(html or "", i)
    out = {r["page_id"]: r for r in rows(warc.op6(df))}
    assert len(out) == len(pages)
    for i, _, html in pages:
        raw = (html or "").encode()
        again = len(raw) >= 100 and first[html] != i
        assert (out[i]["payload_bytes"], out[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (out[i]["record_type"], out[i]["refers_to"]) == (("revisit", first[html]) if again else ("response", None))
    assert warc.op6(df.where("false")).count() == 0


@pytest.mark.parametrize("most", [100_000, 0])
def test_warc_of_repeated_ids(spark, monkeypatch, most):
    for f in (warc.mark_revisits, warc._mend):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], most))
    x, y, z = "x" * 200, "y" * 200, "cut WARC/1.1\r\nhere " * 20
    data = [(1, x), (5, x), (5, x), (7, x), (7, y), (8, y), (1, x), (None, x), (None, y), (9, z), (9, z), (10, z), (3, "s"), (3, "s"), (4, None)]
    df = spark.createDataFrame([(i, "u", t) for i, t in data], "page_id long, url string, html string").withColumn("refers_to", F.lit(3)).repartition(3)
    first = {}
    for i, t in data:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    expected = []
    for i, t in data:
        raw = (t or "").encode()
        again = len(raw) >= 100 and i is not None and i > first[t]
        expected.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[t] if again else None))
    assert sorted(map(tuple, warc.op6(df).collect()), key=str) == sorted(expected, key=str)


def shingle_set(text):
    w = WORDS.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_classes(spark, docs):
    data = [(i, t) for i, t, *_ in corpus()]
    sets = [shingle_set(t) for _, t in data]
    links = defaultdict(set)
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i].add(j)
                links[j].add(i)
    key = lambda x: (x is not None, x or 0)
    expected = []
    for i, (d, _) in enumerate(data):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((data[j][0] for j in seen), key=key)
        expected.append((d, least, len(links[i]), d == least))
    got = [tuple(r) for r in ngram_join.op7(docs.withColumn("sig", F.lit(1))).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    left = ngram_join.without_near_copies(docs)
    assert left.columns == docs.columns and left.select("doc_id").distinct().count() == len({c for _, c, *_ in expected})
    assert ngram_join.op7(empty(spark)).count() == 0


def test_links_of_long_texts_count_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SIDE_BYTES", 700)
    rng = random.Random(12)
    data = []
    for g in range(12):  # groups of two or three near copies of about 600 bytes each, in two or three parts
        base = ["".join(rng.choice("abcdefghik") for _ in range(5)) for _ in range(100)]
        data += [(10 * g + k, " ".join([*base, f"end{k}"])) for k in range(2 + g % 2)]
    out = {r["doc_id"]: r for r in rows(ngram_join.op7(spark.createDataFrame(data, "doc_id long, text string")))}
    assert all((r["n_links"], r["class_id"]) == (1 + i // 10 % 2, i // 10 * 10) for i, r in out.items())


def test_language_id(spark):
    rng = random.Random(4)
    stems = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "schei", "keit"], "fr": ["eau", "ment", "que", "les"]}
    text = lambda k: " ".join(rng.choice(stems[k]) for _ in range(rng.randint(5, 60)))
    data = [(i, text(k := rng.choice(list(stems))), k, "hot" if i % 2 else f"h{i % 7}", 1) for i in range(400)]
    truth = {i: k for i, _, k, *_ in data}
    data += [(900, None, "en", "hot", 1), (901, "", "en", None, 1), (902, "123 !! 456", None, "hot", 1), (903, text("de"), "en", "h1", 1), (904, text("fr") * 3000, None, None, 1), (904, "x", "xx", "h2", 1)]
    df = spark.createDataFrame(data, DOCS).withColumn("confidence", F.lit(2.0)).withColumn("kept", F.lit("z"))
    out = {r["doc_id"]: r for r in rows(langid.op8(df))}
    assert sum(out[i]["lang"] == k for i, k in truth.items()) >= 0.99 * len(truth)
    assert all(out[i]["kept"] for i in truth) and not any(out[i]["kept"] for i in (900, 901, 902)) and out[902]["lang"] is None
    names, table = langid.fit_text_model(df.where("doc_id % 2 = 0"))
    held = langid.identify(df.where("doc_id % 2 = 1 and doc_id < 400").select("doc_id", "text"), names, table, F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    assert all(r["lang"] == truth[r["doc_id"]] for r in rows(held))  # held-out accuracy of the text alone
    kept = langid.in_known_language(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in rows(kept)} >= set(truth)
    assert langid.op8(empty(spark)).count() == 0
    pages = spark.createDataFrame([(1, "https://a.example.de/x", '<html lang="de"><p>der und keit</p></html>'), (2, None, None), (3, "http://h", "<b>")], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in rows(langid.page_languages(pages, df))}
    assert found[1]["lang"] == "de" and not found[2]["kept"] and not found[3]["kept"]


def test_rare_and_many_labels_are_languages(spark):
    rng = random.Random(2)
    data = [(i, " ".join(rng.choice(["the", "and", "thing"]) for _ in range(9)), "en", "h", 1) for i in range(3000)]
    data += [(5000 + i, f"palabra número {i}", f"l{i:02}", "h", 1) for i in range(70)]
    df = spark.createDataFrame(data, DOCS)
    names, table = langid.fit_text_model(df, sample_rows=100, least_rows=20)
    assert names == ["en", *(f"l{i:02}" for i in range(70))] and table.shape == (71, langid.GRAMS)


def test_whole_tags_name_languages(spark):
    data = [(i, "o que e a casa da gente", "pt-BR", "h", 1) for i in range(30)] + [(100 + i, "ang mga bata sa bahay", "fil", "h", 1) for i in range(30)] + [(200 + i, "talo ja kissa on", "fi", "h", 1) for i in range(30)]
    df = spark.createDataFrame(data, DOCS)
    names, table = langid.fit_text_model(df)
    assert names == ["fi", "fil", "pt-BR"]
    tags = spark.createDataFrame([(t,) for t in ("fil", "FIL-PH", "fi_FI", " pt_br ", "pt", "und", "", None)], "t string")
    assert [r.n for r in tags.select(langid._told(names, F.col("t")).alias("n")).collect()] == [1, 1, 0, 2, None, None, None, None]
    assert {r["lang"] for r in rows(langid.op8(df)) if 100 <= r["doc_id"] < 200} == {"fil"}


def test_posterior_by_hand(spark):
    labelled = spark.createDataFrame([(i, w, k, "h", 1) for i in range(40) for k, w in (("de", "der und keit"), ("fr", "eau ment que"))], DOCS)
    names, table = langid.fit_text_model(labelled)
    data = [("der und", "fr", "a.de", "de"), ("eau", None, "a.de", "de"), ("eau ment", "fr", "b.fr", "fr"), ("der", "xx", None, "fr"), ("keit", None, "b.fr", None), ("und", "de", "a.de", "de")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "i long, t string, d string, h string, s string")
    wide = (np.full((2, langid.CLASSES), -100.0), np.ones(2))
    out = {r["i"]: r for r in rows(langid.identify(df, names, table, *(F.col(c) for c in "tdhs"), bands=wide))}
    ll = []
    for t, *_ in data:
        raw = np.frombuffer(t.encode(), np.uint8)
        h, _ = langid.grams(raw, np.array([0, len(raw)]))
        ll.append(table[:, h].astype(np.float64).sum(1) / (1 + len(h) / 200))
    best = [int(np.argmax(x)) for x in ll]
    count = lambda test: np.array([sum(b == k and test(x) for b, x in zip(best, data, strict=True)) for k in (0, 1)], float)
    base = (count(lambda x: True) + 1) / (len(data) + 2)
    told = [(names.index(x[1]), b) for x, b in zip(data, best, strict=True) if x[1] in names]
    trust = min(0.99, (sum(a == b for a, b in told) + 1) / (len(told) + 2))
    for i, (_, d, h, s) in enumerate(data):
        suffix = lambda s: (count(lambda x: x[3] == s) + 100 * base) / (count(lambda x: x[3] == s).sum() + 100)
        prior = suffix(s) if s else base
        if h:
            mine, of = count(lambda x: x[2] == h), min((x[3] for x in data if x[2] == h and x[3]), default=None)
            prior = (mine + 20 * (suffix(of) if of else base)) / (mine.sum() + 20)
        post = ll[i] + np.log(prior) + (np.log([trust if k == names.index(d) else 1 - trust for k in (0, 1)]) if d in names else 0)
        post = np.exp(post - post.max())
        assert out[i]["lang"] == names[int(post.argmax())] and out[i]["confidence"] == pytest.approx(post.max() / post.sum(), rel=1e-6)


def test_a_hosts_own_pages_outweigh_its_suffix(spark):
    words = {"de": "der und keit schei", "fr": "eau ment que les"}
    labelled = spark.createDataFrame([(i, words[k], k, "h", 1) for i in range(60) for k in words], DOCS)
    pages = [(i, f"http://a{i % 9}.de/", words["de"]) for i in range(400)] + [(1000 + i, f"http://b{i % 9}.fr/", words["fr"]) for i in range(400)]
    pages += [(2000 + i, "http://big.de/", words["fr"]) for i in range(60)] + [(3000, "http://big.de/", "a"), (3001, "http://new.de/", "a")]
    out = {r["page_id"]: r for r in rows(langid.page_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), labelled))}
    assert out[3000]["lang"] == "fr" and 0.7 < out[3000]["confidence"] < 0.85 and out[3001]["lang"] == "de"


def test_unlabelled_languages_and_gibberish_are_rejected(spark):
    rng = random.Random(8)
    stems = {"en": ["the", "and", "thing", "with", "ing "], "de": ["der", "und", "schei", "keit", "ung "], "es": ["el ", "ción", "que", "los", "mente"]}
    text = lambda k: " ".join("".join(rng.choice(stems[k]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 80)))
    data = [(i, text(k := list(stems)[i % 3]), k, f"h{i % 5}", 1) for i in range(300)]
    data += [(400, "我们今天去市场买了很多新鲜的蔬菜和水果然后回家做饭给家人吃" * 2, None, "h1", 1), (401, "мы сегодня пошли на рынок и купили много свежих овощей и фруктов", None, "h1", 1)]
    data += [(402, "".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(100)), "en", "h1", 1), (403, "dzisiaj poszliśmy na targ i kupiliśmy dużo świeżych warzyw i owoców a potem", None, "h2", 1)]
    df = spark.createDataFrame(data, DOCS)
    out = {r["doc_id"]: r for r in rows(langid.op8(df))}
    assert all(out[i]["kept"] and out[i]["lang"] == list(stems)[i % 3] for i in range(300))
    assert not any(out[i]["kept"] or out[i]["lang"] or out[i]["confidence"] for i in (400, 401, 402, 403))
    assert {r["doc_id"] for r in rows(langid.in_known_language(df))} == set(range(300))
    pages = spark.createDataFrame([(i, f"http://h{i}.de/", f"<p>{t}</p>") for i, t, *_ in data[-4:] + data[:3]], "page_id long, url string, html string")
    assert {r["page_id"] for r in rows(langid.page_languages(pages, df)) if r["kept"]} == {0, 1, 2}


def quality_by_hand(text):
    words, text = WORDS.findall(text or ""), text or ""
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(spark, docs):
    more = docs.unionByName(spark.createDataFrame([(300, "a b c d e f g h " * 9 + "\nsame\nsame\n \n \n#*$%&|<> x", "de", "s", 1)], DOCS)).withColumn("band", F.lit(1))
    texts = defaultdict(list)
    for r in rows(more):
        texts[r["doc_id"]].append(quality_by_hand(r["text"]))
    for r in rows(op9(more)):
        own = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert own in texts[r["doc_id"]]
        assert r["base_failed"] == (own[0] < 20 or 100 * own[4] > 30 * own[0]) and not (r["base_failed"] and r["kept"])
    assert op9(empty(spark)).count() == 0


def test_fertility_verdict_by_hand(spark):
    import sentencepiece

    from fiscalens.llm import fertility

    rng = random.Random(3)
    plain = ["river", "stone", "market", "letter", "garden", "window", "simple", "number", "people", "common"]
    data = [(i, " ".join(rng.choice(plain) + rng.choice("abc") for _ in range(rng.randint(20, 60))), rng.choice(["en", "de"]), "s", 1) for i in range(80)]
    data += [(100, " ".join("ꙮ" * 9 + str(i) for i in range(30)), "en", "s", 1), (101, " ".join("x" * 40 for _ in range(7)) + " a b c d e f g h i j k l m", "de", "s", 1), (102, None, "en", "s", 1), (103, "short", None, "s", 1)]
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    measured, counts = {}, {}
    for i, text, lang, *_ in data:
        ids = model.encode(text or "")
        n = Counter(ids)
        entropy = None if not ids else 1.0 if len(ids) == 1 else -sum(k / len(ids) * np.log2(k / len(ids)) for k in n.values()) / np.log2(len(ids))
        measured[i] = (len(text or "") / len(ids), sum(model.is_byte(x) for x in ids) / len(ids), entropy) if ids else (None,) * 3
        counts[i] = (lang, quality_by_hand(text))
    edges = {}
    for lang in ("en", "de"):
        for m in range(3):
            values = sorted(round(measured[i][m], 4) for i, (l, c) in counts.items() if l == lang and c[0] >= 20)
            at = lambda part: next(v for k, v in enumerate(values) if k + 1 >= part * len(values))  # noqa: B023, E731
            low, high = at(0.25), at(0.75)
            slack = (0.5, 0.05, 0.1)[m]
            edges[lang, m] = low - 6 * (high - low) - slack, high + 6 * (high - low) + slack
    for r in rows(fertility.op9(spark.createDataFrame(data, DOCS).repartition(3))):
        lang, c = counts[r["doc_id"]]
        own = (r["chars_per_token"], r["byte_share"], r["token_entropy"])
        assert own == pytest.approx(measured[r["doc_id"]])
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        assert r["kept"] == (not failed and all(edges[lang, m][0] <= own[m] <= edges[lang, m][1] for m in range(3)))
        assert r["doc_id"] != 100 or not r["kept"]


def test_line_templates(spark):
    rng = random.Random(9)
    own = lambda: " ".join("".join(rng.choice("abcdefghik") for _ in range(6)) for _ in range(8))
    banner = "all of our pages carry this very same banner line today"
    data = []
    for i in range(40):
        lines = [own(), own()]
        if i % 2:
            lines.insert(1, banner)
        if i % 4 == 0:
            lines.append(f"posted on {i} may 20{i:02} by user{i} in the news")
        if i % 5 == 0:
            lines.append(f"shared by our reader {['anna', 'bert', 'carl', 'dora'][i % 4]} of the local weekend desk")
        if i in (3, 4):
            lines.append("w " * 30)
        if i in (7, 8):
            lines.append("rare line of two documents only")
        data.append((i, "\n".join(lines), "en", "s", 1))
    data += [(100, None, "en", "s", 1), (101, "", "en", "s", 1), (102, "\n\n \n", "en", "s", 1), (103, banner, "en", "s", 1), (103, banner, "en", "s", 1), (None, own(), "en", "s", 1)]
    df = spark.createDataFrame(data, DOCS).withColumn("n_lines", F.lit(1)).repartition(3)
    out = {r["doc_id"]: r for r in rows(linededup.op10(df))}
    texts = {i: t for i, t, *_ in data}
    for i in range(40):
        for line in texts[i].split("\n"):
            gone = line not in out[i]["text"].split("\n")
            recurs = (line == banner and i != 1) or (line.startswith("posted") and i) or (line.startswith("shared") and i) or (line.startswith("w ") and i != 3)
            assert gone == bool(recurs), (i, line)
    assert out[100]["text"] is None and out[101]["text"] == "" and out[102]["text"] == "\n\n \n" and out[103]["text"] == ""
    left = linededup.without_recurring_lines(df)
    assert left.columns == df.columns and {r["doc_id"] for r in rows(left)} == {None, *range(40), 100, 101, 102}
    assert linededup.op10(empty(spark)).count() == 0


def greedy_templates(matrix, likeness):
    found, of = [], []
    for row in matrix:
        agree = [int(((t == row) & f).sum()) for t, f in found]
        if agree and max(agree) >= likeness * len(row) - 1e-9:
            k = agree.index(max(agree))
            found[k][1][:] &= found[k][0] == row
        else:
            k = len(found)
            found.append((row.copy(), np.ones(len(row), bool)))
        of.append(k)
    return of, [(t * f).tolist() for t, f in found]


@pytest.mark.parametrize(("n", "likeness"), [(4, 0.85), (8, 0.85), (24, 0.85), (60, 0.85), (6, 0.3)])
def test_templates_equal_comparison_with_all(n, likeness):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 50, (6, n))
    matrix = np.where(rng.random((300, n)) < 0.1, rng.integers(0, 50, (300, n)), base[rng.integers(0, 6, 300)]).astype(np.uint32)
    matrix[:, : linededup.LEADING] = 7
    of, token, fixed = linededup.templates_of(matrix, likeness)
    expected = greedy_templates(matrix, likeness)
    assert (of.tolist(), (token * fixed).tolist()) == expected


def test_large_leaf_has_the_templates_of_the_whole(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghik") for _ in range(6))
    data = []
    for i in range(120):
        lines = [f"we all saw {word()} {word()} {word()} {word()} {word()}" for _ in range(3)]
        if i % 15 == 0:
            lines.append(f"we all saw {word()} in the old town")
        if i % 20 == 1:
            lines.append(f"we all saw the new house of {word()}")
        data.append((i, "\n".join(lines)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {k: sorted(map(tuple, linededup.drop_recurring_lines(df, leaf_lines=k).collect())) for k in (8, 10_000)}
    assert got[8] == got[10_000] and sum(r[3] for r in got[8]) == 7 + 5


def test_long_lines_vary_in_any_token(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghik") for _ in range(6))
    notice = [word() for _ in range(60)]
    data = [(i, " ".join([*notice[:30], word(), *notice[31:]]) + f"\n{word()} {word()} {word()} {word()}") for i in range(4)] + [(9, " ".join(word() for _ in range(60)))]
    out = {r["doc_id"]: r for r in rows(linededup.op10(spark.createDataFrame(data, "doc_id long, text string")))}
    assert [out[i]["n_dropped"] for i in (0, 1, 2, 3, 9)] == [0, 1, 1, 1, 0]


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    out = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            path = new_folder(spark, "stage")
            out.write.parquet(path)
            out = spark.read.parquet(path)
    assert out.where("not lossless").count() == 0 and out.count() > 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    more = spark.createDataFrame([(i, "der und keit schei " * 9 + f"wort{i}", "de", None, 1) for i in range(6)] + [(3, None, None, None, None), (None, "", None, None, 0)], DOCS)
    clash = {c: F.lit("x") for c in ("_text", "fp", "line", "_size", "_key", "_pass", "rid", "kept", "confidence", "turn", "shard")}
    for k, df in enumerate((more.withColumns(clash), more.limit(0))):
        df.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{k}")
        assert out.columns == ["doc_id", "ids", "n_ids", "n_bytes", "lossless"] and out.where("not lossless").count() == 0 and (out.count() > 0) == (k == 0)


def test_passes_over_a_document_differ(spark):
    import corpus_pipeline

    twice = spark.createDataFrame([(1, "the nononononono " * 50, "en", "s", 1)] * 2, DOCS)
    assert len({tuple(r["ids"]) for r in rows(corpus_pipeline.encoding(spark, twice, ""))}) == 2


def test_op_queries_leave_other_columns_alone(spark, docs):
    names = {c: F.lit("x") for c in ("bytes", "fp", "sig", "rid", "size", "_n", "line", "leaf", "tokens", "band", "n_words", "turn", "ids", "n_tokens", "start", "part", "_t", "_d")}
    for op, tidy in ((tokenfiles.op4, str), (op9, str), (linededup.op10, str), (langid.op8, str)):
        assert sorted(map(tidy, rows(op(docs)))) == sorted(map(tidy, rows(op(docs.withColumns(names)))))
    data, df = vectors(spark)
    assert sorted(map(str, rows(egojoin.op5(df)))) == sorted(map(str, rows(egojoin.op5(df.withColumns({c: F.lit("x") for c in ("raw", "width", "fp", "label", "cell", "interval")})))))
