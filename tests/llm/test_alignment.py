"""op13 against alignment token by token, whole texts encoded by both libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment
from tessera.llm.common import table
from tessera.llm.tokens import byte_letters

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(rows):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(A)))
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(B)))
    letters = {c: b for b, c in byte_letters().items()}
    count, found = Counter(), []
    for _, text in rows:
        found.append(None)
        if not text:
            continue
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        bytes_a = [bytes(letters[c] for c in tokenizer.id_to_token(k)) for k in a]
        bytes_b = [bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode() for k in b]
        raw = (" " + text).encode()
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            continue
        at_a, at_b = spans(bytes_a), spans(bytes_b)
        links, low = [], 0
        for k, (start, end) in enumerate(at_a):
            while at_b[low][1] <= start:
                low += 1
            j = low
            while j < len(at_b) and at_b[j][0] < end:
                links.append((a[k], b[j]))
                j += 1
        groups, i, j = [], 0, 0
        for cut in sorted({e for _, e in at_a} & {e for _, e in at_b}):
            i0, j0 = i, j
            while i < len(a) and at_a[i][1] <= cut:
                i += 1
            while j < len(b) and at_b[j][1] <= cut:
                j += 1
            groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
        count.update(links)
        found[-1] = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for (doc_id, _), f in zip(rows, found, strict=True):
        out.append((doc_id, 0, 0, 0, 0, 0, 0, "") if f is None else (doc_id, *f[:3], len(f[3]), sum(count[p] == top[p[1]] for p in f[3]), sum(count[p] for p in f[3]), f[4]))
    return sorted(out, key=str)


def digests(df, **options):
    return sorted(map(tuple, alignment.align_documents(df, A, B, **options).collect()), key=str)


@pytest.mark.parametrize("block_bytes", [2_000, 4 << 20])
def test_given_tables(spark, sf_dir, block_bytes):
    docs = table(spark, sf_dir, "documents")
    assert digests(docs.repartition(3), block_bytes=block_bytes) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_texts(spark, rows):
    rnd = random.Random(5)
    letters = "ab Z  \n\t\r é日本▁'.,1<|>s/0xA\x00​ 　👍"
    made = [(100 + k, "".join(rnd.choice(letters) for _ in range(rnd.randrange(40)))) for k in range(800)]
    made += [(2000, "<|endoftext|> <s> </s> <unk> <0x0A>"), (2001, " "), (2002, "\n"), (2003, "a" * 300), (None, "the cat"), (2004, "x  \n  y \t\t z\n"), (2005, "▁"), (2006, "the cat "), (2007, "日本語" * 200)]
    df = rows([(i, t) for i, t in made])
    assert digests(df.repartition(4), block_bytes=500) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_empty(spark, empty):
    assert digests(empty) == []


def test_links_overlap():
    rng = np.random.default_rng(1)
    for _ in range(50):
        total = int(rng.integers(1, 40))
        len_a, len_b = (np.diff(np.r_[0, np.sort(rng.choice(np.arange(1, total), rng.integers(0, total), replace=False)) if total > 1 else np.zeros(0, dtype=int), total]) for _ in range(2))
        group_a, group_b, cuts, link_a, link_b = alignment.groups_and_links(len_a, len_b)
        at_a, at_b = spans(["x" * n for n in len_a]), spans(["x" * n for n in len_b])
        assert [*zip(link_a, link_b, strict=True)] == [(i, j) for i, (s, e) in enumerate(at_a) for j, (t, f) in enumerate(at_b) if s < f and t < e]
        assert len(cuts) == group_a[-1] + 1 == group_b[-1] + 1
        assert all(group_a[i] == group_b[j] for i, j in zip(link_a, link_b, strict=True))
