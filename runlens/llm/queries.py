"""One query per operator, with its SQL where SQL can express it."""

from importlib import import_module

PARTS = ["near_dedup", "line_dedup", "quality", "html_text", "licenses", "mixing", "exact_dedup", "pieces", "toxicity", "warc",
         "periodic", "top_search", "conversations"]


def registry() -> dict:
    out: dict = {}
    for part in PARTS:
        out.update(import_module(f"runlens.llm.{part}").QUERIES)
    return out
