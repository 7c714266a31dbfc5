"""Each operator against a plain version on odd rows: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from beamgrid.llm import _components
from beamgrid.llm import _text as t
from beamgrid.llm import chat, decontaminate, log_templates, mixing, repetition, shards, simhash, token_files, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, fp string, found string, repetition string, taken string, n_words string"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def _row(i, text, source="a"):
    return (i, text, "en", source, 0, "x", "x", "x", "x", "x", "x", "x")


@pytest.fixture(scope="module")
def docs(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    plain = [" ".join(f"w{(i * 7919 + k * 104729) % 9973}".translate(letters) for k in range(60)) for i in range(40)]
    rows = [_row(i, x, "abc"[i % 3]) for i, x in enumerate(plain)]
    rows += [_row(100 + i, plain[0], "hot") for i in range(60)]  # a group of copies, and a hot source
    rows += [_row(200, None), _row(201, ""), _row(202, " \n\t "), _row(None, "a null id here it is"), _row(203, plain[1], None)]
    rows += [_row(204, "same row twice"), _row(204, "same row twice"), _row(205, "x" * 300_000), _row(206, "é ü 中文 𝄞 " * 20)]
    rows += [_row(207, f"Before it: {PASSAGE.upper()}, and after"), _row(208, PASSAGE + " " + " ".join(plain[2:12]))]
    rows += [_row(300 + i, f"Visit number {i} of the counter page\nown line {plain[i]}\n\nPage {i} of 99") for i in range(20)]
    rows += [_row(400, "again and again we say\n" * 9 + "end"), _row(401, plain[3] + " tail")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _texts(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]


def _same(a, b):
    assert Counter(a) == Counter(b), (list((Counter(a) - Counter(b)).items())[:3], list((Counter(b) - Counter(a)).items())[:3])


# sharding


def _compact(df):
    return df.withColumns({"size": shards.record_size(), "_row": F.monotonically_increasing_id()}).cache()


def test_shards_are_even_gapless_and_in_order(docs):
    small = docs.where("length(text) < 10000 or text is null")
    out = shards.shard_by_bytes(_compact(small), 4).select("doc_id", "text", "size", "shard", "slot").collect()
    assert len(out) == small.count()
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    last = -1
    for k in range(4):
        own = sorted((r for r in out if r["shard"] == k), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= 2 * largest
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in own]
        assert ids == sorted(ids) and (not ids or ids[0] >= last)
        last = ids[-1] if ids else last


def test_shards_split_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(100).cast("long").alias("size"), F.col("id").alias("_row")).cache()
    plan = shards.split_ranges(df, "doc_id", "_row", "size", 50)
    assert max(plan.n) < 3000 / 50 * 3 and sum(plan.n) == 3000
    n = Counter(r["shard"] for r in shards.shard_by_bytes(df, 10).collect())
    assert all(v == 300 for v in n.values()) and len(n) == 10


def test_shards_cut_beside_large_records(spark):
    """Ranges with a record beyond a share are cut as well, however many small ones lie around it."""
    rows = [(k, 10_000_000 if k in (500, 501, 2900) else 100, k) for k in range(3000)]
    plan = shards.split_ranges(spark.createDataFrame(rows, "doc_id long, size long, _row long").cache(), "doc_id", "_row", "size", 400)
    share = sum(r[1] for r in rows) / 400
    assert sum(plan.n) == 3000 and all(w - 10_000_000 <= 2 * share for w in plan.weight)


def test_op1_against_a_plain_version(spark, docs, tmp_path):
    """The query on odd rows, long texts too: sizes, digests, and the shard that the middle of each record's bytes lies in."""
    from beamgrid.llm import queries

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_sampled_splitters(spark, str(tmp_path)).collect()
    size = lambda x: len((x or "").encode()) + 16
    _same([(r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got], [(i, size(x), zlib.crc32((x or "").encode()), "bytes", None) for i, x, _ in _texts(docs)])
    total, before, last = sum(r["size"] for r in got), 0, -1
    slots: Counter = Counter()
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        assert r.shard == min(39, (2 * before + r["size"]) * 40 // (2 * total)) and r.slot == slots[r.shard]
        assert (-1 if r.doc_id is None else r.doc_id) >= last
        last = -1 if r.doc_id is None else r.doc_id
        slots[r.shard] += 1
        before += r["size"]


def test_shards_of_nothing(empty):
    assert shards.shard_by_bytes(_compact(empty), 4).count() == 0


# token files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return public_tokenizers.path("word_bpe_49k.json"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_token_files_round_trip(spark, docs, tmp_path, tokenizer):
    path, tok = tokenizer
    token_files.write(docs, str(tmp_path / "ids"), path, 2, 49_408)
    got = token_files.read(spark, str(tmp_path / "ids")).collect()
    texts = _texts(docs)
    encoded = {x: [*e.ids, 2] for x, e in zip((t for _, t, _ in texts), tok.encode_batch([t or "" for _, t, _ in texts], add_special_tokens=False), strict=True)}
    crc = lambda x: zlib.crc32(np.array(encoded[x], "<u4").tobytes())
    _same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(i, len(encoded[t]), crc(t)) for i, t, _ in texts])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_token_files_of_nothing(spark, empty, tmp_path, tokenizer):
    token_files.write(empty, str(tmp_path / "none"), tokenizer[0], 2, 49_408)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_pieces_are_encoded_as_whole_texts(tokenizer):
    import pyarrow as pa

    path, tok = tokenizer
    texts = ["it's WE'LL 12.5% áb ½²x ×÷", "'s't'RE ''s \"'s 'story 'll'l 'r", "don’t – “quoted” … a•b", "<|endoftext|> a<|startoftext|>b", "İstanbul ΣΑΣ x\x1cy\x85z", "中文 字符", None, "", "\t", "a'", "'", "i'm'd y'all've", "ÀÉÎ×ÖßÿÞ ª1º"]
    want = [[*e.ids, 2] for e in tok.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    got = [np.frombuffer(x, "<u2").tolist() for _, ids in token_files._Pieces(path).rows(pa.array(texts), 2, "<u2") for x in ids]
    assert got == want


def _piece_ids(path, texts, pieces=None):
    import pyarrow as pa

    return [np.frombuffer(x, "<u2").tolist() for _, ids in (pieces or token_files._Pieces(path)).rows(pa.array(texts, pa.string()), 2, "<u2") for x in ids]


def test_batches_are_encoded_as_whole_texts(tokenizer):
    """What stands next to a row must not change its ids: 60,000 random texts in batches, contractions over row bounds first."""
    path, tok = tokenizer
    assert _piece_ids(path, ["a'", "tea"]) == [[*tok.encode(x, add_special_tokens=False).ids, 2] for x in ("a'", "tea")]
    rng = np.random.default_rng(8)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", "a", "B", " ", "  ", "1", ".", "é", "–", "don", "\n", "'S", "x2"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 9))) for _ in range(60_000)]
    want = [[*e.ids, 2] for e in tok.encode_batch(texts, add_special_tokens=False)]
    pieces = token_files._Pieces(path)
    got = [x for k in range(0, len(texts), 10_000) for x in _piece_ids(path, texts[k : k + 10_000], pieces)]
    assert got == want


def test_pieces_of_equal_hash_go_whole(tokenizer, monkeypatch):
    path, tok = tokenizer
    whole = token_files.t.span_hashes
    monkeypatch.setattr(token_files.t, "span_hashes", lambda v, n, family=0: whole(v, n, family) if family else whole(v, n) % np.uint64(7))
    texts = [f"some word{'abcdefgh'[k % 8]} here {'xyz'[k % 3]} it's" for k in range(50)] + ["", "the", None]
    assert _piece_ids(path, texts) == [[*tok.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


@pytest.mark.parametrize("limit", [4, 6, 20])
def test_huffman_codes(limit):
    rng = np.random.default_rng(limit)
    counts = np.zeros(40, np.int64)
    counts[rng.permutation(40)[: min(15, 1 << limit)]] = 2 ** np.arange(min(15, 1 << limit))
    lengths = token_files.code_lengths(counts, limit)
    used = counts > 0
    assert (lengths[~used] == 0).all() and (lengths[used] > 0).all() and lengths.max() <= limit
    assert sum(2.0 ** -int(x) for x in lengths[used]) == 1.0
    ids = np.repeat(np.flatnonzero(used), 37)[rng.permutation(37 * used.sum())]
    payload, marks = token_files.pack(ids, token_files.canonical_codes(lengths), lengths)
    table, bits = token_files.decode_table(lengths)
    assert (token_files.unpack(payload, marks, len(ids), table, bits) == ids).all()
    if limit == 20:  # without the limit's pressure: an optimal code's cost
        import heapq

        heap = [int(c) for c in counts[used]]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            cost += s
            heapq.heappush(heap, s)
        assert cost == int((counts * lengths).sum())


def test_huffman_of_one_id():
    lengths = token_files.code_lengths(np.array([0, 5, 0]))
    payload, marks = token_files.pack(np.array([1] * 300), token_files.canonical_codes(lengths), lengths)
    assert (token_files.unpack(payload, marks, 300, *token_files.decode_table(lengths)) == 1).all()


# mixing


def test_mix_meets_its_targets(docs):
    out = mixing.taken_words(docs.withColumn("size", mixing.word_count()), [5, 2, 1], block_words=64).collect()
    _same([(r.doc_id, r["size"]) for r in out], [(i, len(WORD.findall(t or ""))) for i, t, _ in _texts(docs)])
    size, taken = Counter(), Counter()
    for r in out:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.source_size and r.taken <= 2 * r["size"]
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(names)}
    capped, total = set(), 1.5 * sum(size.values())
    while True:
        rest, open_ = total - sum(2 * size[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        target = {s: 2 * size[s] if s in capped else rest * weight[s] / open_ for s in names}
        over = {s for s in names if s not in capped and target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    for r in out:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mixing.taken_words(docs.repartition(3).withColumn("size", mixing.word_count()), [5, 2, 1], block_words=64)
    _same([(r.doc_id, r["size"], r.taken) for r in out], [(r.doc_id, r["size"], r.taken) for r in again.collect()])


def _golden(quotas):
    """The schedule as its definition has it: draw by exact golden-ratio points until each quota is met, passing over sources that have."""
    total, out, rank, k = sum(q for _, q in quotas), [], Counter(), 0
    while len(out) < total:
        point, low = (k * mixing.GOLDEN % (1 << 64) >> 16) / (1 << 48), 0
        for name, q in quotas:
            if low / total <= point < (low + q) / total or (low + q == total and low / total <= point):
                if rank[name] < q:
                    out.append((len(out), name, rank[name]))
                    rank[name] += 1
                break
            low += q
        k += 1
    return out


@pytest.mark.parametrize("quotas", [[(1, 2000), (2, 1200), (3, 800)], [(1, 1)], [(k, 1 + k % 4) for k in range(40)], [(1, 5000), (2, 1), (3, 1), (4, 30)]])
def test_schedule_is_the_golden_one(spark, quotas):
    q = spark.createDataFrame(quotas, "nth int, quota long")
    got = sorted(tuple(r) for r in mixing.schedule(q).select("slot", "nth", "rank").collect())
    assert got == _golden(quotas)
    total = sum(n for _, n in quotas)
    for name, n in quotas:  # shares hold at every prefix, but for the end, where sources are used up
        seen = np.cumsum([x == name for _, x, _ in got])
        early = slice(0, int(0.9 * total))
        assert n < 100 or np.abs(seen - n / total * np.arange(1, total + 1))[early].max() < 8


def test_documents_come_by_the_schedule(docs):
    """Each source's words are taken block by block in the order of the golden schedule: first_slot and n_slots against a plain walk."""
    d = docs.withColumn("size", mixing.word_count()).select("doc_id", "source", "size")
    placed, pieces, sources = mixing.mix(d, [5, 2, 1], block_words=64)
    quota = [(r.nth, int(-(-int(r.target + 1e-6) // 64)), int(r.target + 1e-6), r.source_size) for r in sorted(sources.collect(), key=lambda r: r.nth) if int(r.target + 1e-6)]
    words = {n: [None] * size for n, _, _, size in quota}
    for r in placed.collect():
        words[r.nth][r.begin : r.begin + r["size"]] = [r.row] * r["size"] if r["size"] else []
    want = Counter()
    for slot, n, rank in _golden([x[:2] for x in quota]):
        upto, size = next((w, s) for m, _, w, s in quota if m == n)
        for at in range(rank * 64, min((rank + 1) * 64, upto)):
            want[slot, words[n][at % size]] += 1
    got = Counter()
    for r in pieces.collect():
        got[r.slot, r.row] += r.n_words
    assert got == want


def test_mix_of_nothing(empty, spark):
    assert mixing.taken_words(empty.withColumn("size", mixing.word_count()), [1]).count() == 0
    wordless = spark.createDataFrame([_row(1, ""), _row(2, None)], SCHEMA).withColumn("size", mixing.word_count())
    assert [r.taken for r in mixing.taken_words(wordless, [1]).collect()] == [0, 0]


# decontamination


def test_a_part_of_a_benchmark_is_bounded(spark):
    """Windows as a worker holds them: about 45 bytes a word here, whatever the texts; long items are cut, and no window is lost."""
    rng = np.random.default_rng(2)
    words = np.array([f"word{k}" for k in range(50_000)])
    items = [(str(k), " ".join(words[rng.integers(0, len(words), n)])) for k, n in enumerate([3, 40, 5_000, 200_000])]
    whole = decontaminate.Grams(items, 13)
    assert sum(len(h) for h in whole.hashes.values()) == 1 + 28 + 4_988 + 199_988
    limit = 1 << 20
    parts = decontaminate._parts_of(spark.createDataFrame(items, "i string, x string"), 13, limit).collect()
    own = {p: decontaminate.Grams([(r.i, r.x) for r in parts if r.part == p], 13) for p in {r.part for r in parts}}
    assert len(own) > 5 and max(g.nbytes for g in own.values()) <= limit
    assert set(np.concatenate([g.hashes[13] for g in own.values() if 13 in g.hashes]).tolist()) == set(whole.hashes[13].tolist())


@pytest.mark.parametrize("limit", [32 << 20, 3000])
def test_decontamination(spark, docs, limit):
    items = spark.createDataFrame([(1, PASSAGE), (2, "Visit, NUMBER"), (3, None), (4, ""), (10, PASSAGE), (10, "nothing like this anywhere")], "item_id long, text string")
    word, lower = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: re.sub("[A-Z]+", lambda m: m[0].lower(), x or "")
    wins: dict[tuple, set] = {}
    for r in items.collect():
        w = word.findall(lower(r.text))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(r.item_id))
    want = []
    for i, x, _ in _texts(docs):
        w, hit, found = word.findall(lower(x)), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    got = decontaminate.judged(decontaminate.scan(docs, items, broadcast_bytes=limit)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    _same([tuple(r) for r in got.collect()], want)
    kept = decontaminate.clean(docs, items, broadcast_bytes=limit)
    assert kept.columns == docs.columns
    _same([r.doc_id for r in kept.collect()], [w[0] for w in want if not w[-1]])
    cut = {r.doc_id: r.text for r in decontaminate.without_spans(docs, items, broadcast_bytes=limit).collect()}
    assert cut[207] == "Before it: , and after" and cut[200] is None


def test_decontamination_of_nothing(spark, docs, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, items).count() == docs.count()
    assert decontaminate.clean(empty, items).count() == 0


# chat


def test_chat_round_trip(spark):
    rows = [
        (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"),
        (1, 0, "us\ner\x10", "a\x101<|x\x10"), (2, None, None, None), (3, 2, "assistant", "é<"), (3, 1, "assistant", ""), (3, 3, "user", "|z\n"),
        (4, 1, "user", "b"), (4, 1, "user", "a"), (4, 1, "user", "a"), (4, 2, "assistant", "\\ % \x102"), (None, 0, "assistant", "no id"), (5, 0, "assistant", "x" * 50_000),
    ]
    c = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    want = []
    for i in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == i), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want.append((i, len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    e = chat.examples(c)
    _same([tuple(r)[:5] for r in chat.read_back(e).collect()], want)
    for r in e.collect():
        reply = r.formatted[r.loss_start : r.loss_start + r.loss_chars]
        assert "<|" not in reply and r.formatted.endswith(chat.END + "\n")
    three = sorted((r.example, r.loss_chars) for r in e.where("conv_id = 3").collect())
    assert three == [(0, 0), (1, 2), (2, 0)]
    assert chat.read_back(chat.examples(c.limit(0))).count() == 0


# WARC


def test_warc_derivatives(spark):
    page = "<html><head><title>A &amp; B</title><script>x('</p>')</script></head><body><p>One&nbsp;two</p><!-- no --><p>three<br>four <a href='/x'>five</a></body>"
    pages = spark.createDataFrame([(1, "http://a.org/\r\nX: y", page), (2, None, None), (3, "http://b.org/", ""), (1, "http://a.org/\r\nX: y", page)], "page_id long, url string, html string").withColumn("content", F.lit("clash"))
    got = warc.derivatives(warc.responses(pages)).collect()
    assert len(got) == 8
    by = {(r.page_id, r.warc_type): r for r in got}
    assert by[1, "conversion"].content == "A & B\nOne two\nthree\nfour five" and by[3, "conversion"].content == ""
    for r in got:
        headers, block = warc.parse(bytes(r.record))
        h = {k.lower(): v for k, v in headers}
        response = warc.parse(bytes(warc.responses(pages).where(F.col("page_id") == r.page_id).first().response))
        source = {k.lower(): v for k, v in response[0]}
        assert block.decode() == r.content and int(h["content-length"]) == len(block) == r.content_length
        assert h["warc-block-digest"] == warc.sha1_digest(block) == r.block_digest
        assert h["warc-refers-to"] == source["warc-record-id"] == r.refers_to
        assert h["warc-date"] == source["warc-date"] and h["warc-target-uri"] == source["warc-target-uri"]
        assert h["warc-source-payload-digest"] == source["warc-payload-digest"] and h["warc-source-digest-valid"] == "true"
        other = by[r.page_id, "metadata" if r.warc_type == "conversion" else "conversion"]
        assert h["warc-concurrent-to"] == other.record_id
    assert "title: A & B" in by[1, "metadata"].content and "outlinks: 1" in by[1, "metadata"].content
    assert warc.derivatives(spark.createDataFrame([(1, None), (2, b"no record"), (3, b"")], "page_id long, response binary")).count() == 0


def _response(body, http="Content-Type: text/html", extra=()):
    block = f"HTTP/1.1 200 OK\r\n{http}\r\n\r\n".encode() + body
    return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Target-URI", "http://a.org/"), ("Content-Type", "application/http"), *extra], block)


def _parts(data):
    metadata, conversion = warc.derive(data)
    return {k: v for k, v in warc.parse(metadata["record"])[0]}, metadata["content"], conversion["content"]


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (b"<p title='a>b' class=\"c>d\">one</p>", "one"), (b"one<script>if (a < b) x('</p>')", "one"), (b"<!-- no <p>two</p>", ""), (b"<style>p{}</STYLE >x", "x"),
        (b"a < b <3 & c &lt;p&gt;", "a < b <3 & c <p>"), (b"<p class=x'>it's</p>'", "it's\n'"), (b"one<br/>two<unfinished", "one\ntwo<unfinished"), (b"<svg><script>y</script></svg>z", "z"),
        (b"", ""), (b"<a href=x>" * 20_000, ""), (b"w " * 200_000, ("w " * 200_000).strip()), (b"<a" * 100_000, None), (b'<a b="' * 50_000, None),
    ],
)
def test_plain_text(body, text):
    got = _parts(_response(body))[2]
    assert text is None or got == text


def test_warc_bodies_as_sent():
    import gzip

    page = "<title>T é</title><p>hi é there".encode()
    chunked = b"".join(b"%x;n=1\r\n%s\r\n" % (len(page[k : k + 7]), page[k : k + 7]) for k in range(0, len(page), 7)) + b"0\r\n\r\n"
    want = "T é\nhi é there"
    for body, http in ((page, "X: y"), (chunked, "Transfer-Encoding: chunked"), (gzip.compress(page), "Content-Encoding: gzip"), (zlib.compress(page), "content-encoding: deflate"), (page, "Content-Encoding: gzip"), (page, "Transfer-Encoding: chunked"), (page.decode().encode("latin-1"), "Content-Type: text/html; charset='ISO-8859-1'"), (page, "Content-Type: text/html; charset=nonsense")):
        head, about, text = _parts(_response(body, http, [("WARC-Payload-Digest", warc.sha1_digest(body))]))
        assert text == want and "title: T é\r\n" in about
        assert head["WARC-Source-Payload-Digest"] == "sha1:" + __import__("base64").b32encode(hashlib.sha1(body).digest()).decode()
        assert head["WARC-Source-Type"] == "response" and head["WARC-Source-Content-Type"] == "application/http" and head["WARC-Source-Digest-Valid"] == "true"
        assert head["WARC-Source-Block-Digest"].startswith("sha1:") and int(head["WARC-Source-Content-Length"])
    cut = gzip.compress(page * 50)[:-9]
    assert _parts(_response(cut, "Content-Encoding: gzip"))[2].startswith("T é\nhi é there")
    head, _, _ = _parts(_response(page, extra=[("WARC-Payload-Digest", "sha1:OTHER")]))
    assert head["WARC-Source-Digest-Valid"] == "false" and head["WARC-Source-Stated-Payload-Digest"] == "sha1:OTHER"
    head, _, text = _parts(b"WARC/1.0\r\nX: y\r\n\r\nnot http")
    assert text == "not http" and head["X"] == "y"


# quality rules


def test_repetition(docs, empty):
    got = {}
    for r in repetition.score(docs).select("doc_id", "text", "repetition.*").collect():
        got.setdefault(r.doc_id, r)
    for i, x, _ in _texts(docs):
        x, r = x or "", got[i]
        w = WORD.findall(x)
        dup, seen, dup_chars = 0, set(), 0
        for line in x.split("\n"):
            if WORD.search(line):
                dup += line in seen
                dup_chars += (line in seen) * sum(map(len, WORD.findall(line)))
                seen.add(line)
        chars = []
        for n in range(5, 11):
            c = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
            inside = {j for k in range(len(w) - n + 1) if c[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
            if n == 5:
                repeat = len(inside)
            chars.append(sum(len(w[j]) for j in inside))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.dup_line_chars) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, repeat, dup_chars)
        assert list(r.repeat_chars) == chars
        assert r.base_failed == (len(w) < 10 or 100 * repeat > 20 * len(w)) and not (r.kept and r.base_failed)
    assert repetition.keep(docs).columns == docs.columns
    assert repetition.keep(docs).where("doc_id = 400").count() == 0 and repetition.keep(docs).where("doc_id = 5").count() == 1
    assert repetition.keep(empty).count() == 0


# line dedup


def test_log_templates(docs, empty, spark):
    out = {r.doc_id: r for r in log_templates.drop_recurring(docs).collect()}
    for i in range(20):
        r = out[300 + i]
        assert (r.n_lines, r.n_dropped) == (4, 2) and r.text.startswith("own line") and r.text.count("\n") == 1
    assert out[200].text is None and out[200].n_lines == 0 and out[201].text == "" and out[201].n_lines == 1
    assert out[1].n_dropped == 0 and out[100].n_dropped == 0  # a line of sixty copies of one text
    assert log_templates.drop_recurring(docs).count() == docs.count() and log_templates.drop_recurring(empty).count() == 0
    same = spark.createDataFrame([(1, "\n".join(f"visit number {k} here now" for k in range(50)))], "doc_id long, text string")
    assert log_templates.drop_recurring(same).first().n_dropped == 0  # within one document only
    passage = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(50)]
    rows = [(k, f"head {'abc'[k]}\n{' '.join(passage)} {x}\nthe end of {'xyz'[k]}") for k, x in enumerate(("7", "12", "last"))]
    rows += [(10 + k, f"{' '.join(passage)}\nonly {'ab'[k]}") for k in range(2)]  # fifty tokens are no passage
    rows += [(20 + k, f"10 20 30\nonly {chr(97 + k)}") for k in range(10)] + [(40 + k, f"{k} {k + 1} {k + 2}\nno {chr(97 + k)}") for k in range(10)]
    out = {r.doc_id: r for r in log_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[k].n_dropped for k in (0, 1, 2, 10, 11)] == [1, 1, 0, 0, 0] and out[1].text == "head b\nthe end of y"
    assert all(out[20 + k].n_dropped == 1 and out[40 + k].n_dropped == 0 for k in range(10))  # lines of numbers go by their numbers


def test_distinct_and_hash_families():
    h = np.random.default_rng(3).integers(0, 50, 400).astype(np.uint64)
    key, which, back = token_files._distinct(h)
    assert (key == np.unique(h)).all() and (h[which] == key).all() and (key[back] == h).all()
    assert all(len(x) == 0 for x in token_files._distinct(h[:0]))
    values, n = np.frombuffer(b"onetwothree one" * 9, np.uint8), np.array([3, 3, 5, 4] * 9)
    ready = t.runs(values, n)
    plain = lambda k, f: [int(w) * (int(b) + 1) for w, b in zip(t._position_weights(5 + 3 * f)[3 * f :], values[n[:k].sum() : n[: k + 1].sum()])]
    for f in (0, 1):
        out = t.span_hashes(ready, n, f)
        assert (out == t.span_hashes(values, n, f)).all()
        assert (out == t.mixed(np.array([sum(plain(k, f)) % (1 << 64) for k in range(len(n))], np.uint64))).all()


def test_id_counts(spark):
    ids = [np.array(x, "<u2") for x in ([1, 2, 2], [], [7, 65535, 1], [2])]
    rows = spark.createDataFrame([(bytearray(x.tobytes()),) for x in ids], "ids binary")
    for df in (rows, rows.repartition(3), rows.limit(0)):
        out = token_files.id_counts(df, 1 << 16)
        assert {k: int(out[k]) for k in np.flatnonzero(out).tolist()} == ({1: 2, 2: 3, 7: 1, 65535: 1} if df.count() else {})


def test_log_template_words(spark):
    odd = ["", " ", "a", " a  b\tc ", "a b", "\x0b\x0ca 1 b\r", "a\xa0b c d e", "1 2 a", "1 a b", "\r", "a\r\rb\x0bc1", "a  b ", "\x1fa b c", "a b c" * 40]
    line, rows = F.col("line"), spark.createDataFrame([(x,) for x in odd], "line string")
    out = rows.select("line", log_templates.tokens_of(line).alias("tokens"), *[log_templates.has_words(line, n).alias(f"has{n}") for n in range(5)])
    for r in out.collect():
        plain = [x for x in re.split(r"[\x20\x09-\x0D]+", r.line) if x]
        fields = [bool(re.search("[0-9]", x)) for x in plain]
        assert r.tokens == (plain if 2 * sum(fields) > len(plain) else ["<*>" if f else x for x, f in zip(plain, fields)])
        assert [r[f"has{n}"] for n in range(5)] == [len(plain) >= n for n in range(5)]


# SimHash


def test_fingerprint_and_components(docs, empty):
    def plain(x):
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), x or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if h and 2 * sum(v >> b & 1 for v in h) > len(h))

    texts = _texts(docs)
    fp = [plain(t) for _, t, _ in texts]
    root = list(range(len(fp)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(fp)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least: dict[int, int | None] = {}
    for a, (i, _, _) in enumerate(texts):
        r = find(a)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    want = [(i, f"{fp[a]:016x}", least[find(a)]) for a, (i, _, _) in enumerate(texts)]
    _same([tuple(r) for r in simhash.near_duplicates(docs).collect()], want)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    _same([r.doc_id for r in kept.collect()], list(least.values()))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("part", [8192, 40])
def test_links_of_dense_groups(spark, part):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    f = set(base.tolist())
    for b in base[:4]:
        x = int(b)
        for _ in range(150):  # chains and clusters within a few bits
            x ^= sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 4), replace=False))
            f.add(x)
    f = np.array(sorted(f), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in f.view(np.int64)], "fp long")
    got = simhash.links(df, part=part).collect()

    def groups(pairs):
        root = {int(v): int(v) for v in f}

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in pairs:
            root[find(a)] = find(b)
        return Counter(find(int(v)) for v in f), {int(v): find(int(v)) for v in f}

    close = [(int(f[i]), int(f[j])) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 3) + i + 1]
    unsigned = [(r.a % (1 << 64), r.b % (1 << 64)) for r in got]
    assert all((a ^ b).bit_count() <= 3 for a, b in unsigned)
    assert sorted(groups(close)[0].values()) == sorted(groups(unsigned)[0].values())


def _clustered():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    base[:3000] &= np.uint64((1 << 64) - (1 << 26))  # many share two blocks and little else: groups where pivots have work to do
    close = base[:400].copy()
    for k in range(3):
        close ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    return np.unique(np.concatenate([base, close]))


def test_pivots_discard_pairs(spark):
    """In a group of unlike fingerprints the first pivot's window and the others' coordinates leave few to verify, close pairs among them."""
    f = _clustered()
    df = spark.createDataFrame([(int(v),) for v in f.view(np.int64)], "fp long")
    r = simhash.report(df).first()
    assert r.met > 100_000 and r.in_window < 0.7 * r.met and r.survived < 0.01 * r.in_window and 400 <= r.close <= r.survived
    assert simhash.report(df.limit(0)).first().met == 0


def test_links_come_by_the_pivots(monkeypatch):
    """With a table of distances that says every pair is far, nothing is linked."""
    f = _clustered()
    g = np.zeros(len(f), np.int64)
    assert len(simhash.link(g, f, simhash.pivots())[0]) >= 400
    monkeypatch.setattr(simhash, "pivot_table", lambda f, refs: np.stack([np.arange(len(f)) * 4 % 61] * len(refs)).astype(np.int8))
    few = f[:15]
    assert not len(simhash.link(np.zeros(15, np.int64), np.concatenate([few[:14], few[:1] ^ np.uint64(1)]), simhash.pivots())[0])


CLASHES = "row file at own0 own1 own99 key id x n fp node root best doc part parts begin inside nth slot grp place had range upto first bytes_before rows_before hash _id _text_hash _dropped lines gone alias found _found0 cost i rule made _made"


def test_clashing_columns_come_back_unchanged(spark, docs):
    """Extra columns named like anything an operator uses inside keep their values."""
    few = docs.where("doc_id < 120 or doc_id > 202").where("length(text) < 5000")
    names = [c for c in CLASHES.split() if c not in docs.columns]
    few = few.select("doc_id", "text", "source", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in names])
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    sized = few.withColumns({"size": shards.record_size()}).cache()
    numbered = sized.withColumn("number", F.monotonically_increasing_id()).cache()
    made = {
        "shards": shards.shard_by_bytes(numbered, 4, row="number"), "mix": mixing.taken_words(sized, [5, 2, 1], block_words=64), "clean": decontaminate.clean(few, items), "parts": decontaminate.clean(few, items, broadcast_bytes=100),
        "cut": decontaminate.without_spans(few, items), "keep": repetition.keep(few), "lines": log_templates.drop_recurring(few), "simhash": simhash.keep_one(few),
        "urls": url_filter.judge(few.withColumns({"url": F.lit("http://a.net/"), "html": F.lit("")}), RULES), "warc": warc.derivatives(warc.responses(few, "doc_id", "text", "text")),
    }
    for what, df in made.items():
        kept = [c for c in names if not (what in ("shards", "mix") and c in ("slot",)) and not (what == "urls" and c == "rule")]
        rows = df.select("doc_id", *kept).collect()
        assert rows, what
        for r in rows:
            assert all(r[c] == (None if r.doc_id is None else f"{c} of {r.doc_id}") for c in kept), (what, r)


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 180)] + [(200, 201), (201, 200), (300, 300)]
    df = spark.createDataFrame([*edges, (None, 5), (5, None)], "a long, b long")
    got = {r.node: r.root for r in _components.components(df).collect()}
    want = {k: 0 for k in range(61)} | {k: 100 for k in range(100, 180)} | {200: 200, 201: 200}
    assert got == want
    assert _components.components(df.limit(0)).count() == 0


# URL filter

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def test_url_filter(spark):
    rows = [
        (1, "http://alias.org/x?q=1#f", '<link href="https://spam.net/y" rel=canonical>', "block", None), (2, "https://ALIAS.org/x?q=1", None, "block", None), (3, None, "", "allow", None),
        (4, "no scheme", "", "allow", None), (5, "HTTP://A.Example.NET/en/1", '<meta http-equiv="refresh" content="0; url=/fr/2">', "allow", "example.net/en/"), (6, "http://b.org/fr/1", '<link rel="canonical" href="http://c.example.com/de/1">', "allow", "org/fr/"),
        (7, "http://q.info/1", '<META HTTP-EQUIV=refresh content="3;URL=//z.org/2">', "block", None), (8, "http://z.org/2", '<link rel="canonical" href="http://spam.net/y">', "block", None),
        (9, "http://example.net/fr/", "", "block", "net/"), (10, "http://notexample.com/de/", "", "allow", None), (11, "http://x.net?p", "", "allow", None), (1, "http://alias.org/x?q=1#f", None, "block", None),
        (12, "http://a://b.net/", "", "allow", None),
    ]
    pages = spark.createDataFrame([(*r[:3], "clash", "clash") for r in rows], "page_id long, url string, html string, host string, verdict string")
    got = url_filter.judge(pages, RULES)
    _same([(r.page_id, r.verdict, r.rule) for r in got.collect()], [(r[0], r[3], r[4]) for r in rows])
    assert {(r.host, r.path) for r in got.where("page_id in (3, 4)").collect()} == {("", "")}
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}
