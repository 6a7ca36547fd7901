import os
import zlib

import numpy as np
from tokenizers import Tokenizer

from convoweave.llm.queries import WORD_TOKENIZER, op5_token_files
from convoweave.llm.token_files import chunk_encoder, read_token_files, with_checksum, with_start, write_token_files
from convoweave.sources.scratch import scratch_path

os.environ["TOKENIZERS_PARALLELISM"] = "false"
TOKENIZER = Tokenizer.from_file(WORD_TOKENIZER)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def test_chunks_encode_like_whole_texts(edges):
    encode = chunk_encoder(WORD_TOKENIZER, 1)
    texts = [r.text for r in edges.collect()] + [
        "Word, word. word., (word). ,. 1,000 a.b, A.B. don't 'S ,,", "É é İI ΣΣ x y　z\x0bq\x1cw\x85v", "<|ENDOFTEXT|>,<|endoftext|>.", "x" * 3000 + ".",
    ]
    encoded = encode([None if t is None else t.encode() for t in texts])
    for text, raw in zip(texts, encoded):
        assert np.frombuffer(raw, "<u4").tolist() == ids_of(text), (text or "")[:60]


def test_files_hold_all_ids_in_order(spark, edges):
    path = scratch_path(spark, "files")
    write_token_files(edges, path, WORD_TOKENIZER)
    files = read_token_files(spark, path)
    rows = with_start(with_checksum(files)).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))
    texts = {}
    for r in edges.collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    start = 0
    for r in rows:
        assert r.start == start
        expected = {(len(ids_of(t)), zlib.crc32(np.array(ids_of(t), "<u4").tobytes())) for t in texts[r.doc_id]}
        assert (r.n_tokens, r.ids_crc32) in expected
        start += r.n_tokens
    assert len(rows) == edges.count()


def test_partial_reads_are_pushed_down(spark, edges):
    path = scratch_path(spark, "files")
    write_token_files(edges, path, WORD_TOKENIZER)
    files = read_token_files(spark, path)
    plan = files.where("doc_id = 12").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,12)" in plan and "ids" not in plan.split("ReadSchema")[1]
    assert files.where("doc_id = 12").first()["ids"] == ids_of(next(r.text for r in edges.collect() if r.doc_id == 12))


def test_no_rows(spark, no_rows):
    path = scratch_path(spark, "files")
    write_token_files(no_rows, path, WORD_TOKENIZER)
    assert with_start(with_checksum(read_token_files(spark, path))).count() == 0


def test_query_against_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    start, rows = 0, {r.doc_id: r for r in op5_token_files(spark, sf).collect()}
    for i in sorted(docs):
        ids = ids_of(docs[i])
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
