"""Small document tables with every awkward case."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(12_000))
WORDS = [f"word{i}" for i in range(200)]
PASSAGE = " ".join(WORDS[:60])
AWKWARD = [
    None,
    "",
    " \n\t ",
    "one",
    "two words",
    PASSAGE,
    PASSAGE,
    "before this " + PASSAGE + " and after that",
    "lonely " * 90,
    LONG,
    "éà ü 漢字 😀 " * 12,
    "tab\tand\x0bvertical\x0cform\rreturn" + " z" * 50,
    " nbsp is no space here",
    "x" * 5000,
]
