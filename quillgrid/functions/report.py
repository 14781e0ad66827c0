"""Errors in words, with the place in the document they are about."""

from __future__ import annotations

from quillgrid.functions.markdown import parse

_WORDS = {
    "Prefix": "should begin with {expected!r}, but has {actual!r}",
    "Suffix": "should go on with {expected!r}, but has {actual!r}",
    "Matcher": "should match {expected}, but has {actual!r}",
    "Literal": "should be {expected!r}, but is {actual!r}",
}


def _range(error: dict) -> str:
    low, high = error["min"], error["max"]
    if high is None or low == high:
        return f"exactly {low}"
    return f"{low or 0} to {high}"


def sentence(error: dict) -> str:
    code = error["code"]
    if code == "NodeContentMismatch":
        return "Text " + _WORDS[error["kind"]].format(**error)
    if code == "NodeTypeMismatch":
        return f"Expected {error['expected']}, found {error['actual']}"
    if code == "ChildrenLengthMismatch":
        return f"Expected {_range(error)} children, found {error['received']}"
    if code == "WrongListCount":
        return f"Expected {_range(error)} paragraphs, found {error['received']}"
    if code == "MalformedNodeStructure":
        return {"SchemaHasChildInputDoesnt": "Something is missing here", "InputHasChildSchemaDoesnt": "Nothing more is expected here", "MissingListItemContent": "The list item is empty", "HadExtraListItem": "The list item should be empty"}[error["kind"]]
    return f"{error['category']}: {code}" + (f" ({error['kind']})" if error["kind"] else "")


def report(text: str, errors: list[dict]) -> str:
    """A line for each error: line and column (from 1), then what is wrong."""
    # an error without a node, as where the text could not be read, is about its start
    nodes = list(parse(text).walk()) if any(e["input_index"] for e in errors) else []
    out = []
    for error in errors:
        k = error["input_index"]
        at = nodes[k].start if k is not None and k < len(nodes) else 0
        line = text.count("\n", 0, at) + 1
        out.append(f"{line}:{at - (text.rfind(chr(10), 0, at) + 1) + 1}: {sentence(error)}")
    return "\n".join(out)
