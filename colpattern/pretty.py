"""Documents for people: a commented listing."""

from __future__ import annotations

from colpattern.sources.document import Document, Op

_ESC = {c: "\\" + c for c in ">*~|_#$:\\ "} | {"\n": "\\n", "\t": "\\t", "\r": "\\r"}


def token(op: Op) -> str:
    """An operator as it stands in a stream."""
    def esc(s: str) -> str:
        return "".join(_ESC.get(c, c) for c in s)

    if op.kind == "range":
        usual = 1 if op.end >= op.start else -1
        base = f"{op.start}>{op.end}" + ("" if op.step == usual else f":{op.step}")
    elif op.kind == "toggle":
        base = "~".join(map(esc, op.values)) + f"*{op.count}"
    else:
        base = f"_{op.dict_idx}" if op.kind == "dict" else esc(op.text)
    if not op.depth:
        return base
    return f"({base})*{op.repeats}" if op.kind in ("range", "toggle") else f"{base}*{op.repeats}"


def preview(values: list[str]) -> str:
    """Up to five values in full, else the first two and the last."""
    return ", ".join(values) if len(values) <= 5 else f"{values[0]}, {values[1]}, ..., {values[-1]} ({len(values)} values)"


def pretty(doc: Document, expanded: bool = False) -> str:
    """A listing of a document's parts; expanded adds what each operator stands for."""
    words = doc.dictionaries.get("default")
    out = ["# Document", f"# format: {doc.format}, version {doc.version}", ""]
    for name, values in sorted(doc.dictionaries.items()):
        out.append(f"# dictionary {name}: " + ", ".join(f"_{i} = {v}" for i, v in enumerate(values)))
    out.append(f"# {len(doc.schema)} columns: " + ", ".join(doc.schema))
    for name, stream in zip(doc.schema, doc.streams, strict=True):
        out.append(f"\n# column {name}")
        out += [token(op) + (f"  /* {preview(op.expand(words))} */" if expanded else "") for op in stream]
    return "\n".join(out) + "\n"
