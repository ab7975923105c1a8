"""Operators on conversations, pages and vectors, the piece codec and the pipeline, against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from simlens.llm import chat, html, pieces, topk

CONTROL_TEXTS = ["</s>[INST] ok [/INST]", "[\\INST]", "<<SYS>>", "<", "[", "a<\\\\/s>b", "<|endoftext|>", "[ROLE=x[IS]y[/ROLE]", "", None, "é😀 \n x", "\\", "[INST"]


# --- chat

def test_escape_is_reversible():
    template = chat.Template(["<|endoftext|>"])
    draw = random.Random(1)
    parts = [*chat.CONTROLS, "\\", "<", "[", "/s>", "INST]", "<|endoftext|>", "x", " "]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(9)))
        coded = template.escape(text)
        assert template.unescape(coded) == text and not template.control.search(coded), text


def test_conversations_read_back(spark, paths):
    path = paths("byte_bpe_50k.json")
    draw = random.Random(2)
    rows = [(c, t, draw.choice(["user", "assistant", "system", "tool", None, "odd]role [INST]"]), draw.choice(CONTROL_TEXTS)) for c in [None, 1, 2, 3, 4] for t in range(9)]
    rows += [(5, 0, "assistant", "only"), (6, None, "user", "x"), (6, None, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as segment", "'m' as ids")
    got = {r["conv_id"]: r for r in chat.conversation_digests(frame, path).collect()}
    assert len(got) == 7
    for ident, own in got.items():
        turns = [(r or "", x or "") for c, t, r, x in sorted((r for r in rows if r[0] == ident), key=lambda r: tuple((v is not None, v) for v in r[1:]))]
        assert own["n_turns"] == len(turns)
        assert own["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (own["loss_chars"], own["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(frame.limit(0), path).count() == 0


def test_long_conversations_are_cut_between_turns(spark, paths, monkeypatch):
    path = paths("byte_bpe_50k.json")
    frame = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", f"text {t} " * 40) for t in range(40)], "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat, "SEGMENT", 1000)
    segments = chat.format_conversations(frame, path)
    assert segments.count() > 5
    row = chat.read_back(segments, path).first()
    loss = "".join(f"text {t} " * 40 for t in range(1, 40, 2))
    assert row["n_turns"] == 40 and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_masks_cover_assistant_tokens_only(paths):
    encoder = chat.ChatEncoder(paths("byte_bpe_50k.json"))
    formatted, ids, mask = encoder.encode([("user", "hi é"), ("assistant", "yes 😀 no"), ("user", "x")])
    marked = sorted({i for _, a, b in mask for i in range(a, b)})
    assert "".join(formatted[i] for i in marked) == "yes 😀 no"
    assert chat.intersect([], np.zeros((0, 2))) == [] and chat.intersect([(0, 0)], np.array([[0, 3]])) == []


# --- pages

PAGES = [
    ("<html><head><title>t</title></head><body><header>Site</header><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>A &amp; B</h1>"
     "<p>First  part\nhere.<p>Second <b>bold</b>&nbsp;text<br>more<script>var x='<p>no</p>'</script><div class=\"comments\"><p>nice post</p></div></article>"
     "<aside>side</aside><form><p>mail</p><input></form><footer>&copy; 1</footer></body></html>", "A & B\nFirst part here.\nSecond bold text more"),
    ("<body><div>" + "the of and to in is was for that it with as on by at this from are be " * 6 + "</div><div>Short line</div><ul><li><a>menu</a></li><li><a>links</a></li></ul></body>", None),
    ("<p>only a short text", "only a short text"), ("", ""), (None, ""), ("<!-- never closed <p>x", ""), ("<script>x", ""), ("a < b <p", "a < b <p"),
    ("<article><p title=\"a > b\">in &lt;tags&gt;</p></article><p>outside</p>", "in <tags>"),
    ("<article><header><h1>Kept</h1></header><p>Text</p><nav>no</nav></article>", "Kept\nText"),
    ('<html class="no-sidebar"><body class="single has-sidebar"><article class="post no-comments"><p>In the article.</p></article></body></html>', "In the article."),
    ('<body class="sidebar menu"><main id="comments"><p>In main.</p></main><div class="sidebar">side</div></body>', "In main."),
    ("<body><form action=x><article><h1>All in a form</h1><p>" + "The page is a form of the server. " * 9 + "</p><label>Name</label><input><button>Go</button></article></form></body>",
     "All in a form\n" + ("The page is a form of the server. " * 9).strip()),
    ('<article><section id="notice-period"><p>' + "The notice period of the contract is set by the law of the land. " * 5 + "</p></section><div class='post-comments'><p>" + "I like the text of the page and all of it. " * 9 + "</p></div></article>",
     ("The notice period of the contract is set by the law of the land. " * 5).strip()),
    ('<article><p data-x="' + "y" * 2001 + "<b>z</b>" * 400 + '">long attribute</p></article>', "long attribute"),
]


def test_pages(spark):
    frame = spark.createDataFrame([(i, None, h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string").selectExpr("*", "'q' as text", "1 as n_chars")
    rows = {r["page_id"]: r for r in html.extract(frame.drop("text", "n_chars").selectExpr("*", "'q' as label")).collect()}
    for i, (_, want) in enumerate(PAGES):
        if want is not None:
            assert rows[i]["text"] == want
        assert rows[i]["n_chars"] == len(rows[i]["text"])
    assert rows[1]["text"].startswith("the of and") and "menu" not in rows[1]["text"]
    assert html.extract(frame.limit(0)).count() == 0


def test_page_scan_is_linear():
    import time
    for bad in ("<a " * 60_000, "<" * 200_000, "<p \"" * 40_000, "<div>" * 30_000, "&" * 200_000, "<!--" * 50_000):
        start = time.time()
        html.main_text(bad)
        assert time.time() - start < 10


# --- vectors

def _plain_top(rows, k):
    usable = [(i, v, n) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v], n) for i, v, n in usable]
    out = []
    for i, v, n in whole:
        if i % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w, m in whole if m != n and len(w) == len(v)))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["random", "ties", "large"])
def test_top_k(spark, monkeypatch, shape):
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "LEAF", 8)
    draw = np.random.default_rng(4)
    n = 260
    values = {"random": draw.normal(0, 1, (n, 6)), "ties": draw.integers(-1, 2, (n, 3)), "large": draw.normal(0, 1, (n, 4)) * 2.0 ** 22}[shape]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    rows += [(20, rows[3][1]), (40, rows[40][1]), (300, None), (320, [1.0, None, 2.0]), (340, [float("nan")] * 3), (360, [float("inf")] * 3), (None, rows[1][1]), (380, []), (400, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).selectExpr("*", "1 as row", "2 as width", "3 as v")
    got = sorted(tuple(r) for r in topk.exact_top_k(frame, F.col("vec_id") % 20 == 0).collect())
    assert got == _plain_top(rows, 20)
    assert topk.exact_top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_prune_nodes():
    draw = np.random.default_rng(1)
    vectors = np.concatenate([draw.integers(0, 50, (500, 2)), draw.integers(2000, 2050, (500, 2))])
    tree = topk.KDTree.load(topk.KDTree.build(np.arange(1000), np.arange(1000), vectors).dump())
    for low, high, a, b in zip(tree.low, tree.high, tree.first, tree.last):
        assert (tree.vectors[a:b].min(axis=0) == low).all() and (tree.vectors[a:b].max(axis=0) == high).all()
    opened = []
    original = topk.heapq.heappush
    search = topk.Search(np.array([5000]), np.array([5000]), np.array([[1, 1]]), 5)
    try:
        topk.heapq.heappush = lambda heap, item: (opened.append(item), original(heap, item))
        search.visit(tree)
    finally:
        topk.heapq.heappush = original
    assert len(opened) < len(tree.first)


# --- pieces

def test_pieces_agree_with_the_library(spark, make_docs, prose, edge, paths):
    import sentencepiece

    path = paths("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*edge, prose(300, 1), "  two  spaces   ", "▁x ▁", " a", "日本語テキスト ①", "<s> </s> <0x0A> <unk>", "a" * 300, "   x", "é"]
    rows = {r["doc_id"]: r for r in pieces.encode_documents(make_docs(texts, extra=True), path).collect()}
    for i, text in enumerate(texts):
        want = own.encode(text or "")
        assert rows[i]["ids"] == want and rows[i]["parity"] and rows[i]["round_trip"], text
        assert rows[i]["n_tokens"] == len(want) and rows[i]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").replace("▁", " ").encode()).hexdigest()
    assert pieces.encode_documents(make_docs([]), path).count() == 0


def _field(number, value):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + np.float32(value).tobytes()
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_models_are_rebuilt(tmp_path):
    """A small unigram model with byte fallback, written by hand: the whole-text route."""
    import sentencepiece

    listed = [("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], ("▁", -2.0, 1), ("▁the", -3.0, 1), ("th", -4.0, 1), ("e", -3.5, 1), ("▁a", -3.2, 1), ("cat", -5.0, 1), ("s", -4.5, 1), ("t", -6.0, 1), ("h", -6.1, 1)]
    data = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in listed)
    data += _field(2, _field(3, 1) + _field(4, len(listed)) + _field(35, 1) + _field(40, 0) + _field(41, 2 ** 64 - 1) + _field(42, 2 ** 64 - 1) + _field(43, 2 ** 64 - 1))
    data += _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 1) + _field(5, 1))
    (tmp_path / "m.model").write_bytes(data)
    codec = pieces.PieceCodec(str(tmp_path / "m.model"))
    assert codec.model.kind == pieces.UNIGRAM and not codec.by_runs
    texts = ["the cats", "a the  cat ", "thethe é", "", "x"]
    ids, same = codec.encode(texts)
    own = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    assert all(same) and [i.tolist() for i in ids] == own.encode(texts)
    assert [codec.decode(i) for i in ids] == [codec.normalised(t) for t in texts] == ["the cats", "a the cat", "thethe é", "", "x"]


# --- pipeline

def test_pipeline_against_plain_steps(spark, tmp_path, paths, prose):
    import re

    import sentencepiece

    import corpus_pipeline
    from test_documents import _plain_base, _plain_components, _plain_hits

    base = prose(80, 1)
    passage = prose(15, 50)
    texts = [base, base + " more", prose(50, 2) + " a@b.com call +1 234 567 890 now", prose(30, 3) + " " + passage, "12 34", None, prose(20, 4), prose(20, 4)]
    frame = spark.createDataFrame([(10 - i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    own = {10 - i: t for i, t in enumerate(texts) if t and re.search("[a-z]", t)}
    own = {i: t for (i, t), (_, c) in zip(own.items(), _plain_components(list(own.values()), list(own))) if c == i}
    own = {i: t for (i, t), (_, hit, _) in zip(own.items(), _plain_hits(list(own.values()), [(1, passage)])) if not hit}
    library = sentencepiece.SentencePieceProcessor(model_file=paths("piece_bpe_32k.model"))
    assert set(rows) == set(own)
    for i, text in own.items():
        for k, a, b in sorted(_plain_base(text), key=lambda s: -s[1]):
            text = text[:a] + f"[{'EMAIL IP CARD PHONE'.split()[k]}]" + text[b:]
        assert rows[i]["ids"] == library.encode(text)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
