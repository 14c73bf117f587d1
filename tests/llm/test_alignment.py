"""Cross-tokenizer alignment against plain encoding and a comparison of all token pairs."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from eventmesa.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts():
    r = random.Random(6)
    parts = ["the", " ", "  ", "\n", "\n ", " \n  ", "\t", "straße", "élan", "１２", "日本語", "🙂", "don't", "<|endoftext|>", "</s>", "<0x41>", "a" * 90, "12345", "!!", "\u00a0", "\u3000", "\x1c", ".", "ingly", "\r\n"]
    out = [None, "", " ", "   ", "a", " a ", "\0", "a b\0 c", "x▁y", "▁", "the the the", "the the the", "word " * 4000, "é" * 9000, "a" * 300 + " b"]
    return out + ["".join(r.choices(parts, k=r.randint(1, 40))) for _ in range(300)]


def plain(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    codes = {c: i for i, c in alignment_bytes().items()}
    found, docs = {}, defaultdict(set)
    for name, text in rows:
        ends, ids = [], []
        raw = (" " + (text or "")).encode()
        for side in (0, 1):
            encoded = (a.encode(" " + text, add_special_tokens=False) if side == 0 else b.encode(text)) if text else None
            ids.append((encoded.ids if side == 0 else encoded) if text else [])
            pieces = [bytes(codes[c] for c in t) for t in encoded.tokens] if text and side == 0 else [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids[1])] if text else []
            if b"".join(pieces) != raw:
                ids, ends = [[], []], [[0], [0]]
                break
            at = [0]
            for p in pieces:
                at.append(at[-1] + len(p))
            ends.append(at)
        links = []
        j = 0
        for i in range(len(ids[0])):
            while ends[1][j + 1] <= ends[0][i]:
                j += 1
            k = j
            while k < len(ids[1]) and ends[1][k] < ends[0][i + 1]:
                links.append((ids[0][i], ids[1][k]))
                k += 1
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0][1:]) & set(ends[1][1:])):
            x, y = ends[0].index(end), ends[1].index(end)
            groups.append(",".join(map(str, ids[0][i:x])) + "|" + ",".join(map(str, ids[1][j:y])))
            i, j = x, y
        found[name] = (ids, links, groups)
        for pair in set(links):
            docs[pair].add(name)
    counts = {p: len(x) for p, x in docs.items()}
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return {name: (len(ids[0]), len(ids[1]), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for name, (ids, links, groups) in found.items()}


def alignment_bytes():
    """Byte to character, by the public rule of byte-level vocabularies."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@pytest.mark.parametrize("small", [False, True])
def test_alignment_matches_plain_comparison(spark, monkeypatch, small):
    if small:  # many batches, and a cache that is often emptied
        monkeypatch.setattr(alignment, "BATCH_BYTES", 500)
        monkeypatch.setattr(alignment, "CACHE_CHUNKS", 5)
        monkeypatch.setattr(alignment, "TOGETHER", 3)
        alignment.chunks_for.cache_clear()
    rows = list(enumerate(texts()))
    given = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, text string, batch int, counts string").repartition(3)
    got = {x[0]: tuple(x[1:]) for x in alignment.reports(given, A, B).collect()}
    assert got == plain(rows)
    assert alignment.reports(given.limit(0), A, B).count() == 0


def test_repeated_rows_and_links(spark):
    given = spark.createDataFrame([(1, "don't  stop"), (1, "don't  stop"), (None, None), (2, "é 🙂")], "doc_id long, text string")
    reports = alignment.reports(given, A, B).collect()
    twice = [x for x in reports if x.doc_id == 1]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].count_sum == 2 * twice[0].n_links
    for x in alignment.alignments(given, A, B).collect():
        r = next(y for y in reports if y.doc_id == x.doc_id)
        assert (len(x.a), len(x.b), len(x.link_a), len(set(x.group_a))) == (r.n_a, r.n_b, r.n_links, r.n_groups)
        assert x.group_a == sorted(x.group_a) and set(x.group_a) == set(x.group_b) == set(range(r.n_groups))
        assert len(set(zip(x.link_a, x.link_b, strict=True))) == r.n_links
        assert all(x.group_a[i] == x.group_b[j] for i, j in zip(x.link_a, x.link_b, strict=True))
