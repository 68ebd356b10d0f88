"""Token-id output: flat files of unsigned integers with 64-bit document offsets, read back through memory maps.

Documents are dealt by ranges of their id and sorted within a range, so part k holds the k-th range. Each part is

* ``part-k.bin``: the ids of its documents one after another (16 bits each where the vocabulary allows, else 32),
* ``part-k.off``: 64-bit offsets of its documents in that file, one more than documents,
* ``part-k.doc``: their 64-bit document ids (null ids come first and are counted in the manifest).

``manifest.json`` lists the parts with their base, the number of ids in all parts before: a prefix sum over the parts, of
which there are few whatever the documents. A task writes under a name of its own and renames at its end, so a repeated
task leaves the same files.

Edge cases
----------
* null or empty text: the end id alone;
* special tokens that stand in a text get their own ids, as from the library's call without further settings;
* null document ids sort first; equal ids stand next to each other, in the order of a hash of their text;
* no document: a manifest without parts; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import words as W
from .scratch import shared_dir

#: Bytes of input for one part.
PART_BYTES = 16 << 20
MIN_PARTS = 12


#: Distinct words that a task keeps encoded; beyond, it starts anew.
CACHE = 400_000
#: Bytes of text encoded at a time.
CHUNK = 8 << 20
#: Letters, then marks: the tokenizer cuts between the two (an apostrophe may begin a contraction and is left to it). Letters beyond
#: Latin-1 are left to the library too: lower-casing may make other characters of them.
_WORD_AND_MARKS = re.compile(r"^(?:([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)|(.*))$", re.MULTILINE)


class WordEncoder:
    """The tokenizers library on distinct words and runs of marks; a piece's ids are those of its word and of its marks."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.flat, self.end = np.zeros(0, np.uint32), np.zeros(1, np.int64)  # entry k ends at end[k] and begins where k - 1 ends

    def _add(self, names: list[str], ids: np.ndarray, end: np.ndarray) -> None:
        self.number.update(zip(names, range(len(self.number), len(self.number) + len(names))))
        self.flat, self.end = np.concatenate([self.flat, ids]), np.concatenate([self.end, len(self.flat) + end])

    def _learn(self, words: list[str], others: list[str]) -> None:
        """``words`` are one word or one run of marks each: many are encoded as one text, and cut after the ids that end words."""
        number, encode = self.number, lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        new = [x for x in dict.fromkeys(words) if x not in number]
        if new:
            ids = np.fromiter(chain.from_iterable(encode([" ".join(new[i : i + 500]) for i in range(0, len(new), 500)])), np.uint32)
            end = np.flatnonzero(self.final[ids]) + 1
            if len(end) == len(new):
                self._add(new, ids, end)
            else:  # a vocabulary of another kind
                others = [*others, *new]
        new = [x for x in dict.fromkeys(others) if x not in number]
        if new:
            ids = encode(new)
            self._add(new, np.fromiter(chain.from_iterable(ids), np.uint32), np.cumsum([len(x) for x in ids]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts (large strings without nulls) one after another, and where each text begins, with the end.

        Texts are cut at ASCII blanks, over which the tokenizer never joins anything, and each distinct piece is encoded once.
        """
        if len(self.number) > CACHE:
            self._reset()
        lists = pc.ascii_split_whitespace(texts)
        pieces = lists.flatten().dictionary_encode()
        halves = _WORD_AND_MARKS.findall("\n".join(pieces.dictionary.to_pylist())) if len(pieces.dictionary) else []
        words, marks, others = ([x[i] for x in halves] for i in range(3))
        words = list(map(str.lower, words))
        self._learn([*words, *marks], others)
        # A piece is three entries, of which one or two are the empty one.
        entry = np.array([list(map(self.number.__getitem__, x)) for x in (words, marks, others)], np.int32).reshape(3, -1).T
        number = pieces.indices.to_numpy(zero_copy_only=False)
        begin = np.concatenate([[0], self.end[:-1]])
        size = self.end - begin
        out, per_piece = [], size[entry].sum(axis=1)
        for at in range(0, len(number), 1 << 18):
            own = entry[number[at : at + (1 << 18)]].ravel()
            own = own[own > 0]
            each = size[own]
            out.append(self.flat[np.repeat(begin[own] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))])
        bounds = np.concatenate([[0], np.cumsum(per_piece[number])])
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return np.concatenate(out) if out else np.zeros(0, np.uint32), bounds[offsets]


def word_encoder(path: str) -> WordEncoder:
    """Encodes whole texts as the library does when nothing is set: special tokens in a text get their own ids, none is added."""
    from tokenizers import Tokenizer

    return WordEncoder(Tokenizer.from_file(path))


def _write(path: str, root: str, end_id: int, kind: str):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        fs, base = pafs.FileSystem.from_uri(root)
        part = TaskContext.get().partitionId()
        name = f"{base}/part-{part:06d}"
        own = f"{base}/.{part:06d}-{uuid.uuid4().hex}"
        cache, sizes, ids, nulls = None, [np.zeros(1, np.int64)], [], 0
        with fs.open_output_stream(f"{own}.bin") as out:
            for rows in source:
                cache = cache or word_encoder(path)
                texts = rows.column("text").cast(pa.large_string()).fill_null("")
                nulls += rows.column("id").null_count
                ids.append(rows.column("id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                _, offsets = W.buffers(texts)
                for at, to in W.chunks(offsets, CHUNK):
                    found, begin = cache.encode(texts.slice(at, to - at))
                    out.write(np.insert(found, begin[1:], end_id).astype(kind).tobytes())
                    sizes.append(np.diff(begin) + 1)
        if len(sizes) == 1:
            fs.delete_file(f"{own}.bin")
            return
        with fs.open_output_stream(f"{own}.off") as out:
            out.write(np.cumsum(np.concatenate(sizes)).astype("<i8").tobytes())
        with fs.open_output_stream(f"{own}.doc") as out:
            out.write(np.concatenate(ids).tobytes())
        for end in ("bin", "off", "doc"):
            fs.move(f"{own}.{end}", f"{name}.{end}")
        del cache
        W.release()
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [sum(map(len, ids))], "ids": [int(sum(x.sum() for x in sizes))], "nulls": [nulls]})

    return run


def write_token_files(docs: DataFrame, tokenizer: str, root: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes every text, appends ``end_id`` and writes the files under ``root`` (a URI that all executors share); returns it."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    root = root or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    fs, base = pafs.FileSystem.from_uri(root)
    fs.create_dir(base, recursive=True)
    docs = X.columns_of(docs, id_col, text_col)
    kind = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = min(1 << 20, max(MIN_PARTS, size // PART_BYTES))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    dealt = docs.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    rows = dealt.mapInArrow(_write(tokenizer, root, end_id, kind), "part long, docs long, ids long, nulls long").collect()
    rows.sort(key=lambda r: r["part"])
    starts = np.cumsum([0, *(r["ids"] for r in rows)]).tolist()
    manifest = {"kind": kind, "end_id": end_id, "ids": starts[-1], "parts": [{**r.asDict(), "base": b} for r, b in zip(rows, starts)]}
    with fs.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return root


class Part:
    """One part's arrays: memory maps where the folder is a mounted one, else read in whole."""

    def __init__(self, root: str, part: int, kind: str):
        fs, base = pafs.FileSystem.from_uri(root)
        name = f"{base}/part-{part:06d}"
        if isinstance(fs, pafs.LocalFileSystem):
            self.bin, self.off, self.doc = (np.memmap(f"{name}.{e}", dtype=k, mode="r") for e, k in (("bin", kind), ("off", "<i8"), ("doc", "<i8")))
        else:
            self.bin, self.off, self.doc = (np.frombuffer(fs.open_input_file(f"{name}.{e}").readall(), k) for e, k in (("bin", kind), ("off", "<i8"), ("doc", "<i8")))

    def ids(self, k: int) -> np.ndarray:
        return np.asarray(self.bin[self.off[k] : self.off[k + 1]])


def read_manifest(root: str) -> dict:
    fs, base = pafs.FileSystem.from_uri(root)
    with fs.open_input_stream(f"{base}/manifest.json") as found:
        return json.loads(found.read())


def read_token_files(spark: SparkSession, root: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32[, ids]) of every document; ids and their checksum as little-endian unsigned 32-bit integers."""
    manifest = read_manifest(root)
    kind, parts = manifest["kind"], manifest["parts"]
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for listed in source:
            for row in listed.itertuples():
                part = Part(root, row.part, kind)
                n = len(part.doc)
                for at in range(0, n, 1000):
                    some = range(at, min(n, at + 1000))
                    found = [part.ids(k).astype("<u4").tobytes() for k in some]
                    ids = pd.array(part.doc[at : some.stop], dtype="Int64")
                    ids[np.arange(at, some.stop) < row.nulls] = pd.NA
                    out = {"id": ids, "start": row.base + part.off[at : some.stop], "n_tokens": np.diff(part.off[at : some.stop + 1]), "ids_crc32": [zlib.crc32(x) for x in found]}
                    yield pd.DataFrame(out | ({"ids": found} if with_ids else {}))

    listed = spark.createDataFrame([(p["part"], p["base"], p["nulls"]) for p in parts], "part long, base long, nulls long")
    return listed.repartition(max(1, len(parts))).mapInPandas(run, schema).withColumnRenamed("id", id_col)
