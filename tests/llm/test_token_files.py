import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from orrery.llm import sequence_files as S
from orrery.llm.common import scratch_dir
from orrery.llm.text_encoding import PieceEncoder, has_cut_safe_splitter


def test_files_round_trip(prepared, edge_docs, tokenizer_json):
    spec = tokenizer_json("byte_bpe_50k.json")
    library = Tokenizer.from_str(spec)
    out = scratch_dir(prepared, "tokens")
    index = S.write_sequences(edge_docs, out, spec, end_id=2, seq_len=16, batch_rows=4).collect()
    found = [tuple(r) for r in S.document_digests(prepared, out).collect()]
    rows = sorted(((r.doc_id, r.text or "") for r in edge_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    wanted, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        wanted.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(found, key=lambda r: r[1]) == wanted
    files = {r.file_no for r in index}
    seen = 0
    for no in sorted(files):
        file = S.SequenceFile(S.file_uri(out, no))
        own = [r for r in index if r.file_no == no]
        total = sum(r.n_tokens for r in own)
        assert len(file) == -(-total // 16)
        pieces = [file.sequence(k) for k in range(len(file))]
        assert all(len(i) == len(m) == 16 for i, m in pieces) and sum(int(m.sum()) for _, m in pieces) == total
        assert all(m.dtype == np.uint8 and not m.flags.owndata and not i.flags.owndata for i, m in pieces)
        assert np.array_equal(np.concatenate([i for i, _ in pieces])[:total], file.tokens(0, total))
        seen += total
    assert seen == start


def test_empty(prepared, empty_docs, tokenizer_json):
    out = scratch_dir(prepared, "tokens")
    S.write_sequences(empty_docs, out, tokenizer_json("byte_bpe_50k.json"), end_id=2)
    assert S.document_digests(prepared, out).collect() == []


def test_pieces_encode_as_whole_texts(tokenizer_json):
    spec = tokenizer_json("byte_bpe_50k.json")
    encoder, library, draw = PieceEncoder(spec, cache_pieces=500), Tokenizer.from_str(spec), random.Random(3)
    bits = ["a", "The", " ", "  ", "\n", "\t", "'s", "é", "日本", "1", "23", ".", ",", "<|endoftext|>", "\xa0", "\x1c", "😀", "_", "-"]
    texts = ["".join(draw.choices(bits, k=draw.randint(0, 25))) for _ in range(3000)]
    for at in range(0, len(texts), 300):
        for text, ids in zip(texts[at : at + 300], encoder.encode(texts[at : at + 300]), strict=True):
            assert np.frombuffer(ids, encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    assert has_cut_safe_splitter(spec) and not has_cut_safe_splitter(tokenizer_json("word_bpe_49k.json"))


def test_hot_id_is_many_files(prepared, tokenizer_json):
    """Rows of a null id are dealt to ranges by their texts, in order; each file is read back by its own task."""
    texts = [f"{k * 7919 % 400:03d} words of a row" for k in range(400)]
    df = prepared.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    spec, out = tokenizer_json("byte_bpe_50k.json"), scratch_dir(prepared, "tokens")
    prepared.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would else be one partition
    try:
        files = {r.file_no for r in S.write_sequences(df, out, spec, end_id=2, seq_len=16).collect()}
    finally:
        prepared.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 1
    digests = S.document_digests(prepared, out)
    library, start, wanted = Tokenizer.from_str(spec), 0, []
    for t in sorted(texts):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        wanted.append((None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in digests.collect()), key=lambda r: r[1]) == wanted
