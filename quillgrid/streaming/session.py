"""One document that grows, judged at hand: the streaming operator without Spark.

A session is fed the whole text so far, as often as it grows.  Before the end only
what no further text can mend is an error; at the end the report is that of the whole
text, whatever was reported on the way.

Blocks before the last are judged once: a session goes on where it was.

Defined cases: a text no longer than the one before changes nothing; text that comes
after the end raises :class:`ReadAfterEnd`; a session of a complete text has ended.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from quillgrid.functions.report import report as in_words
from quillgrid.operators.api import json_of
from quillgrid.operators.compare import Growing


class ReadAfterEnd(RuntimeError):
    """Text came for a document that had ended."""


@dataclass
class Session:
    schema: str
    text: str = ""
    ended: bool = False
    errors: list[dict] = field(default_factory=list)
    value: dict = field(default_factory=dict)

    def __post_init__(self):
        self.growing = Growing(self.schema).read(self.text)

    @classmethod
    def of(cls, schema: str, text: str) -> Session:
        """A session of a complete text, judged."""
        return cls(schema, text, True).validate()

    def read(self, text: str, end: bool = False) -> Session:
        """Take the whole text so far."""
        if self.ended:
            raise ReadAfterEnd("the document has ended")
        if len(text) > len(self.text):
            # a text that does not go on with what was read is another one
            same = text.startswith(self.text)
            self.growing = self.growing.read(text[len(self.text) :]) if same else Growing(self.schema).read(text)
            self.text = text
        self.ended = end
        return self

    def validate(self) -> Session:
        found = self.growing.judge(self.ended)
        self.errors, self.value = found.errors, found.value
        return self

    @property
    def is_valid(self) -> bool:
        return not self.errors

    @property
    def json(self) -> str:
        return json_of(self.value)

    def report(self) -> str:
        """The errors in words, a line each."""
        return in_words(self.text, self.errors)
