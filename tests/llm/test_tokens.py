"""Operators 1, 4 and 9 against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from pagefold.llm import bpe_trie, packing, queries, token_files
from pagefold.llm.common import ChunkEncoder, scratch_path, tokenizer_path

SMALL = "/root/testdata/sf0.001"
BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def ids_of(library, path, texts):
    return [e.ids for e in library[path].encode_batch([t or "" for t in texts], add_special_tokens=False)]


def noise(n):
    rnd = random.Random(0)
    letters = "abcdefthinger .,'!?é\n <|>12sS\t\xa0"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_trie_codec_equals_the_library(library, rows):
    texts = [r[1] or "" for r in rows] + noise(400)
    codec = bpe_trie.WordCodec(WORD)
    want = ids_of(library, WORD, texts)
    assert codec.encode(texts) == want
    assert [codec.decode(i) for i in want] == [library[WORD].decode(i, skip_special_tokens=False) for i in want]


def test_a_full_memo_changes_no_id(library):
    texts = noise(200)
    codec, coder = bpe_trie.WordCodec(WORD, cache_items=5), ChunkEncoder(BYTE, cache_items=5, longest=3)
    for i in range(0, 200, 20):
        part = texts[i:i + 20]
        assert codec.encode(part) == ids_of(library, WORD, part)
        assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(part)] == ids_of(library, BYTE, part)


def test_chunk_encoder_equals_the_library(library, rows):
    texts = [r[1] or "" for r in rows] + noise(600) + [" ", "  ", "\n", " a", "a ", "x \n", " \n x", "­ soft ­", "a " * 999]
    coder = ChunkEncoder(BYTE)
    assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts)] == ids_of(library, BYTE, texts)


def test_op1_awkward_rows(spark, docs, rows, library):
    got = Counter(map(tuple, bpe_trie.token_digests(docs, WORD).collect()))
    want = Counter()
    for r, ids in zip(rows, ids_of(library, WORD, [r[1] for r in rows])):
        text = library[WORD].decode(ids, skip_special_tokens=False)
        want[r[0], len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest()] += 1
    assert got == want
    whole = {(r["doc_id"], tuple(r["ids"])) for r in bpe_trie.encode_decode(docs, WORD).collect()}
    assert whole == {(r[0], tuple(i)) for r, i in zip(rows, ids_of(library, WORD, [r[1] for r in rows]))}


def test_op1_given_documents_and_empty_table(spark, given, library, no_docs):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in queries.op1_bpe_trie(spark, SMALL).collect()}
    ids = ids_of(library, WORD, [g["text"] for g in given])
    assert got == {g["doc_id"]: (len(i), sha256(" ".join(map(str, i)).encode()).hexdigest()) for g, i in zip(given, ids)}
    assert bpe_trie.token_digests(no_docs, WORD).count() == 0


def test_values_round_trip():
    rnd = random.Random(2)
    for n in range(40):
        v = np.array([rnd.choice([rnd.randrange(256), rnd.randrange(1 << 16), rnd.randrange(1 << 24), rnd.randrange(1 << 32)])
                      for _ in range(n)], dtype=np.uint32)
        control, data = token_files.encode_values(v)
        assert len(control) == -(-n // 4)
        assert token_files.decode_values(control, data, n).tolist() == v.tolist()


def test_block_ranks_by_frequency():
    ranks, control, data = token_files.encode_block(np.array([7, 9, 9, 50_000, 9, 7], dtype=np.uint16))
    assert np.frombuffer(ranks, "<u4").tolist() == [9, 7, 50_000]
    assert token_files.decode_values(control, data, 6).tolist() == [1, 0, 0, 2, 0, 1]


@pytest.mark.parametrize("block_ids", [1, 500, 10_000_000])
def test_op4_awkward_rows(spark, docs, rows, library, block_ids):
    out = scratch_path(spark, "test-files")
    token_files.write_token_files(docs, BYTE, out, end_id=0, shards=5, block_ids=block_ids)
    got = token_files.document_digests(spark, out).collect()
    crc = lambda ids: zlib.crc32(np.array(ids + [0], "<u4").tobytes())
    want = [(r[0], len(i) + 1, crc(i)) for r, i in zip(rows, ids_of(library, BYTE, [r[1] for r in rows]))]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(want)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted((w[0] for w in want), key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in ordered] == list(np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1])


def test_op4_empty_table(spark, no_docs):
    out = scratch_path(spark, "test-files")
    token_files.write_token_files(no_docs, BYTE, out, end_id=0)
    assert token_files.document_digests(spark, out).count() == 0


def test_plan_places_every_piece_once():
    rnd = random.Random(3)
    for _ in range(150):
        width = rnd.choice([5, 16, 64, 1024])
        counts = {rnd.randint(1, width): rnd.randint(0, 60) for _ in range(rnd.randint(0, 25))}
        bins, placed = defaultdict(list), Counter()
        for length, rank, many, sequence, offset in packing.plan(counts, width):
            for k in range(many):
                bins[sequence + k].append((offset, length))
                placed[length, rank + k] += 1
        assert placed == Counter((n, r) for n, c in counts.items() for r in range(c))
        for held in bins.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= width


def test_plan_is_close_to_the_least():
    counts = {700: 100, 324: 100, 512: 51, 100: 40, 24: 90}
    runs = packing.plan(counts, 1024)
    assert max(s + m for _, _, m, s, _ in runs) <= -(-sum(n * c for n, c in counts.items()) // 1024) + 1


def test_cut_leaves_the_short_piece_first():
    assert packing.cut(3, 4) == [(0, 3)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_op9_awkward_rows(spark, docs, rows, library, no_docs):
    width = 64
    got = packing.pack(docs, BYTE, end_id=2, width=width).collect()
    want = Counter()
    for r, ids in zip(rows, ids_of(library, BYTE, [r[1] for r in rows])):
        ids = ids + [2]
        for k, (s, n) in enumerate(packing.cut(len(ids), width)):
            want[r[0], k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0] + [n for _, n in sorted(parts)])[:-1])
        assert sum(n for _, n in parts) <= width
    assert packing.pack(no_docs, BYTE, width=width).count() == 0


def test_op9_keeps_ids_if_asked(spark, docs):
    row = packing.pack(docs.filter("doc_id = 4"), BYTE, width=64, keep_ids=True).first()
    assert zlib.crc32(row["ids"]) == row["ids_crc32"]


def test_rows_of_plain_chunks_are_looked_at_together(library):
    texts = [" ".join(f"word{i}x{j}\nnext{j}" for j in range(200)) for i in range(20)]
    texts += ["字 " + texts[0], "<|endoftext|> here", "a\n b", "a \nb", "c\n\nd e  f", "\n g"]
    coder, looked = ChunkEncoder(BYTE), []
    plain = coder._plain
    coder._plain = lambda x: looked.append(x) or plain(x)
    assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts)] == ids_of(library, BYTE, texts)
    assert len(looked) < 400        # of 4000 distinct chunks


def test_encoding_does_not_wake_the_collector(library):
    import gc

    texts = [" ".join(f"{chr(97 + i)}{chr(97 + j % 26)}w{i * 500 + j}" for j in range(500)) for i in range(20)]
    codec, coder, woken = bpe_trie.WordCodec(WORD), ChunkEncoder(BYTE), []
    watch = lambda phase, info: woken.append(info["generation"])
    for encode in (codec.encode, coder.encode):
        gc.collect()
        gc.callbacks.append(watch)
        try:
            encode(texts)
        finally:
            gc.callbacks.remove(watch)
        assert len(woken) < 5 and gc.isenabled()
        woken.clear()
    with pytest.raises(TypeError):
        codec.encode([None])
    assert gc.isenabled()


def test_plain_runs_are_cut_together(library):
    """The file's pattern is not called for runs of plain letters, digits and marks, and no id changes."""
    rnd = random.Random(11)
    letters = "abcdeSTRMLVXYZ'''0123.,!?-#$&|<>()\xc0\xc9\xd7\xdf\xe9\xf7\xfcĀıĲŉŸſ"
    texts = ["".join(rnd.choice(letters + "  ") for _ in range(rnd.randint(0, 80))) for _ in range(500)]
    codec = bpe_trie.WordCodec(WORD)
    looked, split = [], codec.split
    codec.split = lambda x: looked.append(x) or split(x)
    assert codec.encode(texts) == ids_of(library, WORD, texts) and not looked
    odd = ["x<|endoftext|>'S A<|STARTOFTEXT|>b", "İx é ΣΣ \xb2 中", "<| endoftext |>", "it's IT'S 's''s 'sx"]
    assert codec.encode(odd) == ids_of(library, WORD, odd) and looked
