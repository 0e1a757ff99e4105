import random
import re

import numpy as np
import public_tokenizers
import tiktoken

from willowfold.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CODEC = byte_bpe.codec(PATH)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
ALPHABET = " \n\t\r\x1c\x85\xa0 'stvemlrdaé日本ñ0123٣!?-_\U0001f600́ΣABthe"


def test_tables_of_many_pieces_agree_with_the_library():
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for text, ids in zip(texts, CODEC.encode_texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text)


def test_pieces_of_all_code_points_agree_with_the_library():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    cut = lambda t: [p for c in byte_bpe._CHUNK.findall(t) for p in byte_bpe.pieces_of(c)]
    # ids of single bytes, so that what a kind of character matches is what is left of a text of all of them
    single = {bytes([b]): b for b in range(256)}
    kinds = {k: tiktoken.Encoding("one", pat_str=k, mergeable_ranks=single, special_tokens={}) for k in (r"\p{L}", r"\p{N}", r"\s")}
    held = {k: set("".join(e.decode(e.encode_ordinary("".join(points[at : at + 20_000]))) for at in range(0, len(points), 20_000))) for k, e in kinds.items()}
    for c in points:
        letter, number, white = (c in held[k] for k in kinds)
        assert white == bool(re.fullmatch(f"[{byte_bpe.WHITE}]", c))
        if not white:
            assert len(cut(f"a{c}a")) == (1 if letter else 3) and len(cut(f"1{c}1")) == (1 if number else 3), hex(ord(c))
    texts = ["".join(f"a{c}b {c}1{c} {c}" for c in points[at : at + 64]) for at in range(0, len(points), 64)]
    assert all("".join(cut(t)) == t for t in texts)
    some = texts[:1200] + texts[1200::40]
    for text, ids in zip(some, CODEC.encode_texts(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text)


def test_appends_and_edits():
    rng = random.Random(6)
    for _ in range(300):
        text, more = ("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(2))
        i = rng.randint(0, len(text))
        j = rng.randint(i, len(text))
        table = byte_bpe.TextTable(CODEC, text)
        table.append(more)
        assert table.ids() == CODEC.encode(text + more)
        table = byte_bpe.TextTable(CODEC, text)
        table.edit(i, j, more)
        assert table.ids() == CODEC.encode(text[:i] + more + text[j:])
    piece = byte_bpe.PrefixTable(CODEC, b"tokenisation")
    piece.append(b"al")
    assert piece.ids() == byte_bpe.PrefixTable(CODEC, b"tokenisational").ids() == REFERENCE.encode_ordinary("tokenisational")
    piece.edit(2, 5, b"xyz")
    assert piece.ids() == byte_bpe.PrefixTable(CODEC, b"toxyzisational").ids()


def test_round_trip(documents, odd, nothing):
    for docs in (documents, odd):
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        got = byte_bpe.decode(byte_bpe.encode(docs, PATH), PATH).collect()
        assert sorted((str(r.doc_id), bytes(r["bytes"]).decode()) for r in got) == sorted((str(d), t) for d, t in rows)
        want = {t: REFERENCE.encode_ordinary(t) for _, t in rows}
        assert all(np.frombuffer(r.ids, "<u4").tolist() == want[bytes(r["bytes"]).decode()] for r in got)
    assert byte_bpe.encode(nothing, PATH).count() == 0
