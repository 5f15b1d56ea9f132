import io
import zlib

import numpy as np
import pytest
import zstandard

from cladespark.llm import tokens
from cladespark.llm.token_store import TokenFile, TokenFileWriter, token_store


def test_file_round_trip_and_seek():
    rng = np.random.default_rng(3)
    docs = [(k * 3, rng.integers(0, 50000, rng.integers(1, 4000)).astype("<u4")) for k in range(60)]
    sink = io.BytesIO()
    writer = TokenFileWriter(sink, frame_bytes=10000)
    for doc_id, ids in docs:
        writer.add(doc_id, ids.tobytes())
    writer.close()
    file = TokenFile(sink)
    assert [(d, i.tolist()) for d, i in file.documents()] == [(d, i.tolist()) for d, i in docs]
    touched = []
    whole, file.frame = file.frame, lambda k: touched.append(k) or whole(k)
    assert [(d, i.tolist()) for d, i in file.documents([9, 90])] == [(d, i.tolist()) for d, i in docs if d in (9, 90)]
    assert len(touched) == 2 < len(file.frames)
    reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.getvalue()), read_across_frames=True)
    assert reader.read() == b"".join(i.tobytes() for _, i in docs)
    damaged = bytearray(sink.getvalue())
    damaged[20] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(TokenFile(io.BytesIO(damaged)).documents())


@pytest.mark.parametrize("rows", [[], [(5, "b c", "x"), (1, None, "y"), (2, "", None), (2, "", None), (-1, "minus one", None), (None, "no id", None), (None, "also none", None), (4, "Hello,  world.\n\nà\t!" * 3000, "z")]])
def test_query_against_whole_text_encoding(spark, rows):
    path = tokens.vocabulary("byte_bpe_50k.json")
    got = token_store(spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3), path)
    encode = tokens.Encoder(path)._tokenizer.encode
    want, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_what_whole_texts_give(name):
    encoder = tokens.Encoder(tokens.vocabulary(name))
    odd = ["", " ", "\n", "a  b\n\n c \n", "tab\there  \tq  ", "x\xa0 y", "don't   can't ' s", "á ́b", "<|endoftext|> hi<|endoftext|>", "é1२३ 12 345", "ª º µ ÀÉß İx ſ .a , b.. x,. É. ß, .", "Σας ΑΣ \x1c z\x85"]
    for text in odd:
        whole = np.array(encoder._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode(text) == whole, text
