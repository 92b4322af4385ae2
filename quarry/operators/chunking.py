"""Chunking: syntax nodes where a grammar is at hand, else recursive splits with overlap.

Python is parsed by its own grammar, JavaScript and TypeScript by :mod:`quarry.operators.syntax`. Lengths are in code points. Ids are hashes of where a chunk is."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quarry import config as C
from quarry.functions.imports import import_summary
from quarry.operators import syntax

# Where texts are split, in order of preference.
SEPARATORS = {
    "python": ("\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", ""),
    "js": ("\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault ", "\n\n", "\n", " ", ""),
}
GRAMMARS = {".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".py": "python"}
def _extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""


def split_text(text: str, size: int = C.CHUNK_MAX_LENGTH, overlap: int = C.CHUNK_OVERLAP, language: str | None = "js") -> list[str]:
    """Parts of at most ``size`` characters, cut at the first separator of the language that occurs; each
    part begins with up to ``overlap`` characters of whole pieces of the one before."""
    return [p for p in _split(text, SEPARATORS[language or "js"], size, overlap) if p]


def _split(text: str, separators: tuple[str, ...], size: int, overlap: int) -> list[str]:
    if len(text) <= size:
        return [text.strip()]
    at = next(k for k, s in enumerate(separators) if s in text)
    sep, finer = separators[at], separators[at + 1 :]
    pieces = list(text) if not sep else re.split(f"(?={re.escape(sep)})", text)
    out: list[str] = []
    window: list[str] = []
    total = 0
    for piece in pieces:
        if len(piece) > size and finer:
            if window:
                out.append("".join(window).strip())
            out += _split(piece, finer, size, overlap)
            window, total = [], 0
            continue
        if window and total + len(piece) > size:
            out.append("".join(window).strip())
            while window and (total > overlap or total + len(piece) > size):
                total -= len(window.pop(0))
        window.append(piece)
        total += len(piece)
    if window:
        out.append("".join(window).strip())
    return out


def _python_nodes(content: str) -> list[dict]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return []
    lines, found, level = content.split("\n"), [], [tree]
    while level:  # breadth first, at every depth
        for node in level:
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                first = lines[node.lineno - 1].encode()[node.col_offset :].decode()
                last = lines[node.end_lineno - 1].encode()[: node.end_col_offset].decode()
                body = [first, *lines[node.lineno : node.end_lineno - 1], last] if node.end_lineno > node.lineno else [first]
                found.append({"type": "class" if isinstance(node, ast.ClassDef) else "function", "name": node.name, "content": "\n".join(body), "start": node.lineno, "end": node.end_lineno})
        level = [c for node in level for c in ast.iter_child_nodes(node)]
    return found


def semantic_nodes(path: str, content: str) -> list[dict]:
    """Classes and functions at every depth by start line; none for other languages."""
    kind = GRAMMARS.get(_extension(path))
    nodes = [] if kind is None else _python_nodes(content) if kind == "python" else syntax.nodes(content)
    return sorted(nodes, key=lambda n: n["start"])


def split_file(repo_id: str, path: str, content: str, cfg: C.Config = C.Config()) -> list[dict]:
    """Chunks of one file: its nodes, or the whole file as ``generic_1``. Parts of what is too long are
    ``generic`` and keep the node's name and lines."""
    language = {"python": "python"}.get(GRAMMARS.get(_extension(path), ""), "js")
    summary = import_summary(content, path) if cfg.index_import_summary else ""
    nodes = semantic_nodes(path, content) or [{"type": "generic", "name": "generic_1", "content": content, "start": 1, "end": content.count("\n") + 1}]
    out = []
    for k, n in enumerate(nodes):
        long = len(n["content"]) > cfg.chunk_max_length
        parts = split_text(n["content"], cfg.chunk_max_length, cfg.chunk_overlap, language) if long else [n["content"]]
        for j, part in enumerate(parts):
            key = hashlib.sha256(f"{repo_id}\0{path}\0{k}\0{j}\0{part}".encode()).hexdigest()[:32]
            out.append({"id": key, "repo_id": repo_id, "file_path": path, "content": part, "chunk_type": "generic" if long else n["type"], "chunk_name": n["name"], "start_line": n["start"], "end_line": n["end"], "import_summary": summary or None})
    return out


CHUNKS = "id string, repo_id string, file_path string, content string, chunk_type string, chunk_name string, start_line int, end_line int, import_summary string"


def chunk_files(files: DataFrame, cfg: C.Config = C.Config()) -> DataFrame:
    """Chunks of ``(repo_id, path, content)`` files, file by file in one narrow pass; a null content is
    empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        for batch in batches:
            rows = [c for r, p, t in zip(batch.repo_id, batch.path, batch.content, strict=True) for c in split_file(r, p, t or "", cfg)]
            yield pd.DataFrame(rows, columns=names).astype({"start_line": "int32", "end_line": "int32"})

    return files.select("repo_id", "path", "content").mapInPandas(run, CHUNKS)
