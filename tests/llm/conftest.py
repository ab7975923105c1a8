
import pytest


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def paths():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path


@pytest.fixture
def make_docs(spark):
    def make(texts, langs=None, ids=None, extra=False):
        ids = list(range(len(texts))) if ids is None else ids
        langs = [None] * len(texts) if langs is None else langs
        rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in zip(ids, texts, langs)]
        frame = spark.createDataFrame(rows, DOCS).repartition(3)
        if extra:       # columns whose names the operators use inside
            for name in ("row", "label", "token", "size", "at", "number", "h", "part", "spans", "kind", "window", "score", "ids"):
                frame = frame.selectExpr("*", f"'x' as {name}")
        return frame
    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture
def prose():
    import random

    def make(n, seed):
        draw = random.Random(seed)
        return " ".join(draw.choice(WORDS) + str(draw.randrange(50)) for _ in range(n))
    return make


EDGE = [None, "", " ", "\n\t", "a", "A b", "é", "😀 z", "x" * 5000, "same text", "same text", "tab\tand\nline", "nul\x00byte", "<|endoftext|> [INST] </s>"]


@pytest.fixture
def edge():
    return list(EDGE)
