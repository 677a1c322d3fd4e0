"""Alignment of two tokenizers against a plain version over whole texts."""

import base64
import random
from collections import Counter

from tests.llm.test_operators import documents, frame


def plain(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    bytes_a = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    bytes_b = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    texts, pairs = [], Counter()
    for i, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[x] for x in a) != whole or b"".join(map(bytes_b, b)) != whole:
            texts.append((i, [], [], [], ""))
            continue
        spans = []
        for ids, size in ((a, lambda x: len(bytes_a[x])), (b, lambda x: len(bytes_b(x)))):
            at, out = 0, []
            for x in ids:
                out.append((at, at + size(x), x))
                at += size(x)
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        links = [(x, y) for s, e, x in spans[0] for f, g, y in spans[1] if s < g and f < e] if len(a) < 500 else _links(*spans)
        of = lambda span, lo, hi: ",".join(str(x) for s, e, x in span if lo < e <= hi)
        if len(a) < 500:
            groups = ";".join(of(spans[0], lo, hi) + "|" + of(spans[1], lo, hi) for lo, hi in zip([0, *cuts], cuts))
        else:
            groups = None
        pairs.update(links)
        texts.append((i, a, b, links, groups if groups is not None else len(cuts)))
    top = Counter()
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    out = []
    for i, a, b, links, groups in texts:
        n_groups = groups if isinstance(groups, int) else len(groups.split(";")) if groups else 0
        out.append((i, len(a), len(b), n_groups, len(links), sum(pairs[x] == top[x[1]] for x in links), sum(pairs[x] for x in links), None if isinstance(groups, int) else groups))
    return out, pairs


def _links(a, b):
    out, j = [], 0
    for s, e, x in a:
        while b[j][1] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][0] < e:
            out.append((x, b[k][2]))
            k += 1
    return out


def rows():
    rng = random.Random(7)
    odd = ["a b c", "x\r\ny {\r\n}\r\n  z", "tab\tand\x1cinfo", "it's  'S  we'll\n\n\n end  ", " leading", "　full", "a▁b other words", "▁", "\n\nx", "  ", "\x00\x01 nul", "<s> hi </s> <0x0A>", "é‍\U0001f469‍\U0001f467"]
    odd += ["".join(rng.choice("ab \n\t\r é漢'1!{};") for _ in range(60)) for _ in range(60)]
    return documents() + [(1000 + i, t) for i, t in enumerate(odd)] + [(7, "a b"), (7, "a b"), (None, None)]


def key(r):
    return (r[0] is None, r[0] or 0, r[1:6], r[7] or "")


def check(spark, some, **options):
    import public_tokenizers as P

    from tidemark.llm.align import aligned

    got, counts = aligned(frame(spark, some), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"), **options)
    want, pairs = plain(some)
    got = sorted((tuple(r) for r in got.collect()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=key)):
        assert g[:7] == w[:7], (g, w)
        assert w[7] is None or g[7] == w[7]
    assert {(r.a, r.b): r.links for r in counts.collect()} == pairs
    top = Counter()
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    assert all(r.best == (r.links == top[r.b]) for r in counts.collect())


def test_alignment_is_that_of_whole_texts(spark):
    check(spark, rows())
    check(spark, rows(), chunk=1)  # a chunk for each batch of texts


def test_alignment_of_nothing(spark):
    check(spark, [])
    check(spark, [(1, None), (None, "")])


def test_uncut_texts_give_the_same_groups():
    import public_tokenizers as P

    from tidemark.llm.align import Aligned, Pair

    pair = Pair(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"))
    assert pair.cuts
    texts = [t for _, t in rows() if t]
    cut = [Aligned(pair, pair.units(" " + t)) for t in texts]
    pair.cuts = False
    for t, a in zip(texts, cut):
        b = Aligned(pair, pair.units(" " + t))
        assert a.ok.all() == b.ok.all()
        if b.ok.all():
            assert b"".join(a.groups) == b"".join(b.groups) and a.links.tolist() == b.links.tolist()
