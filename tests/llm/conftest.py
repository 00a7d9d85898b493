"""Small tables with the hard cases, as the queries read them."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

BASE = (
    "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall pine tree near the old mill "
    "and the river runs quietly past fields of barley towards the distant hills where shepherds keep their flocks at night"
)
DOCUMENTS = [
    (0, BASE, "en", "src0"),
    (1, BASE, "en", "src0"),
    (2, BASE.replace("quick", "slow"), "en", "src1"),
    (3, None, "en", None),
    (4, "", None, "src1"),
    (5, "one", "en", "src0"),
    (6, " \t\n\r\x0b\x0c ", "de", "src2"),
    (7, "Héllo wörld, it's déjà vu — naïve İstanbul ǅ ﬁn 日本語 é é <|endoftext|> ½ ²  x y \x1c z", "fr", "src2"),
    (8, ("spam eggs " * 3000) + "\n" + "line\n" * 50, "en", "src0"),
    (9, "a b c d e f g h i j k l m n o p\na b c d e f g h i j k l m n o p\n#*$%&|<>", "en", "src1"),
    (10, BASE.upper(), "en", "src0"),
    (11, " ".join(f"w{i}" for i in range(20000)), "en", "src3"),
    (12, "x" * 50000, None, None),
    (13, "it's we'll they'd I'm you've 'tis 12345 a1b2 foo_bar --- ... !!", "en", "src2"),
    (14, BASE + " and more", "en", "src0"),
]


def write(folder, name, rows, schema):
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema), folder / f"{name}.parquet")


DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


@pytest.fixture(scope="session")
def tables(tmp_path_factory):
    """Makes a folder of tables from rows of documents (and others by name)."""

    def make(documents=DOCUMENTS, pages=(), benchmark=()):
        folder = tmp_path_factory.mktemp("tables")
        write(folder, "documents", [(*r, len(r[1] or "")) for r in documents], DOC_SCHEMA)
        write(folder, "pages", pages, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]))
        write(folder, "benchmark", benchmark, pa.schema([("item_id", pa.int64()), ("text", pa.string())]))
        return str(folder)

    return make
