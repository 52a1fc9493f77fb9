"""Drawing files of real folders."""

import pytest

from draftweave.sources.files import read_drawing_files
from tests.conftest import rows

FILES = {
    "a.pdf": b"%PDF-1.7 rest", "empty.png": b"", "deep/er/still/b c%20.png": b"\x89PNG\r\n\x1a\n...", "deep/x.txt": b"no",
    "deep/_part=1/é.pdf": b"%PDF", ".hidden/c.pdf": b"%PDF", "_temporary/d.pdf": b"%PDF", "deep/.e.pdf": b"%PDF", "deep/_f.pdf": b"%PDF",
}
SEEN = {name: content for name, content in FILES.items() if not any(
    part.startswith(".") or (part.startswith("_") and "=" not in part) for part in name.split("/"))}


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "in coming"
    for name, content in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(content)
    (top / "bare" / "empty").mkdir(parents=True)
    return top


def expected(folder, names):
    return sorted((f"file:{folder}/{n}", len(FILES[n]), bytearray(FILES[n][:8])) for n in names)


def listed(frame):
    return sorted(tuple(r) for r in frame.select("path", "length", "header").collect())


def test_files_of_every_level(spark, folder):
    assert listed(read_drawing_files(spark, str(folder))) == expected(folder, SEEN)
    assert listed(read_drawing_files(spark, f"file:{folder}/")) == expected(folder, SEEN)


def test_paths_are_those_of_the_readers(spark, folder):
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder)).select("path")
    # Spark's reader passes over empty files.
    assert rows(read_drawing_files(spark, str(folder)).filter("length > 0"), "path") == rows(reader)


def test_pattern_holds_for_names(spark, folder):
    names = [n for n in SEEN if n.endswith((".pdf", ".png"))]
    assert listed(read_drawing_files(spark, str(folder), "*.{pdf,png}")) == expected(folder, names)


def test_one_file_an_empty_folder_and_a_missing_one(spark, folder):
    one = folder / "a.pdf"
    assert listed(read_drawing_files(spark, str(one))) == expected(folder, ["a.pdf"])
    assert listed(read_drawing_files(spark, str(one), "*.png")) == []
    assert listed(read_drawing_files(spark, str(folder / "bare"))) == []
    with pytest.raises(FileNotFoundError):
        read_drawing_files(spark, str(folder / "nowhere"))
