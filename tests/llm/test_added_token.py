"""The vocabulary's added token inside texts."""

from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict

from libgauge.llm import packing
from libgauge.llm.tokens import encoder


def test_added_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["<|endoftext|> x", "a  <|endoftext|>", "<|endoftext|><|endoftext|>", "a <|endoftext|>\n b  c", "<|endoftext|", "<<|endoftext|>|>", "<|ENDOFTEXT|>", "é<|endoftext|>日本", "a  b", ""]
    for t in odd:
        ids = encoder().ids(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(t, add_special_tokens=False).ids
    rows = {r.doc_id: r for r in packing.cut_documents(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")).collect()}
    for k, t in enumerate(odd):
        ids = [*library.encode(t, add_special_tokens=False).ids, packing.END_ID]
        assert (rows[k].length, rows[k].ids_crc32) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))


def test_long_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in (" " * 1_000_000, "a" + "\n " * 9_000 + "<|endoftext|> b", "x" + " " * 400_000 + "y"):
        ids = encoder().ids(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(t, add_special_tokens=False).ids


def test_query(spark, tmp_path):
    """The registered query against the contract's own call, and the open-bin limit in effect."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(int(rng.paretovariate(1) * 60))) for _ in range(1500)] + [None, "", " " * 1_000_000, "a <|endoftext|> b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = packing.op4_best_fit_packing(spark, str(tmp_path)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 2], 0
        assert len(pieces[i]) == -(-len(ids) // 1024)
        for k, p in enumerate(sorted(pieces[i], key=lambda p: p.piece)):
            own = ids[at : at + p.length]
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(struct.pack(f"<{len(own)}I", *own))) and (k == 0 or p.length == 1024)
            at += p.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(sequences) <= 1.05 * -(-sum(r.length for r in rows) // 1024) + 1


def test_open_bins():
    rng, packer, most = random.Random(3), packing.BestFit(1024, 32), 0
    for _ in range(5000):
        packer.place(rng.randrange(400, 1024))
        most = max(most, packer.open)
    assert most == 32
