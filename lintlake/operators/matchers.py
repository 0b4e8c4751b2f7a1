"""How one rule is evaluated on a text column: test, count, text before the first match, evidence.

Everything is a SQL expression on ``content`` and ``_lowered`` (``content`` with A-Z in lower case, of the same length). Most patterns run as they are. Seven
would scan the whole rest of a file again for every start and are evaluated in a linear form with the same
matches; ``tests/test_matchers.py`` compares them with the originals.
"""

from __future__ import annotations

from lintlake.functions.regex import DOTALL, WORD, folded, java
from lintlake.functions.sqltext import any_contains, quoted
from lintlake.rules import Rule

EVIDENCE_CHARS = 80


class Matcher:
    """The pattern itself, tried only on texts that contain the rule's required substrings."""

    scope = "content"

    def __init__(self, rule: Rule):
        self.rule = rule
        self.body = java(rule.pattern)
        self.regex = quoted(DOTALL + self.body)

    def may_hit(self) -> str:
        text = "_lowered" if self.rule.folded else "content"
        return " AND ".join(any_contains(text, words) for words in self.rule.needs) or "true"

    def hit(self) -> str:
        if self.rule.folded:
            return f"rlike({self.scope.replace('content', '_lowered')}, {quoted(DOTALL + folded(self.rule.pattern))})"
        return f"rlike({self.scope}, {self.regex})"

    def count(self) -> str:
        return f"regexp_count({self.scope}, {self.regex})"

    def before(self) -> str:
        return f"regexp_extract({self.scope}, {quoted(rf'{DOTALL}\A(.*?)(?:{self.body})')}, 1)"

    def evidence(self) -> str:
        return f"left(regexp_extract({self.scope}, {self.regex}, 0), {EVIDENCE_CHARS})"

    def secret(self) -> str:
        """First group of the first match: the secret itself, for secret rules."""
        return f"regexp_extract(content, {self.regex}, 1)"


class ClosedBy(Matcher):
    """A pattern whose matches all end with ``closer``: nothing after the last one can take part,
    and up to there every start finds an end at once."""

    def __init__(self, rule: Rule, closer: str):
        super().__init__(rule)
        self.scope = f"regexp_extract(content, {quoted(rf'{DOTALL}\A.*{closer}')}, 0)"


class OpenedInVain(Matcher):
    """A pattern with a part that runs from an ``opener`` to a ``closer`` any distance away and there ends. An opener behind the
    last closer would be followed to the end of the text in vain, again for every start. Those openers are made another
    character that no part of the pattern asks for; then each opener that is tried finds its closer, and the match that it
    makes moves the search behind it. Places and lengths stay, so evidence is cut from the text itself."""

    def __init__(self, rule: Rule, openers: str, closer: str):
        super().__init__(rule)
        upto = f"regexp_extract(content, {quoted(rf'{DOTALL}\A.*{closer}')}, 0)"
        self.scope = f"concat({upto}, translate(substring(content, length({upto}) + 1), {quoted(openers)}, {quoted(chr(1) * len(openers))}))"

    def evidence(self) -> str:
        return f"substring(content, length({self.before()}) + 1, least({EVIDENCE_CHARS}, length(regexp_extract({self.scope}, {self.regex}, 0))))"


class HeadToLast(Matcher):
    """``head.*closer`` with a greedy dot: one match, from the first head to the last closer after it."""

    HEAD = java(r"""exec(?:Sync)?\s*\(\s*[`'"]""")

    def hit(self) -> str:
        return f"contains(regexp_extract(content, {quoted(rf'{DOTALL}{self.HEAD}(.*)\z')}, 1), {quoted('${')})"

    def count(self) -> str:
        return "1"

    def before(self) -> str:
        return f"regexp_extract(content, {quoted(rf'{DOTALL}\A(.*?){self.HEAD}')}, 1)"

    def evidence(self) -> str:
        return f"left(regexp_extract(content, {quoted(rf'{DOTALL}{self.HEAD}.*\$\{{')}, 0), {EVIDENCE_CHARS})"


class QuotedNestedRepeat(Matcher):
    """Greedy dots on both sides: the only match runs from the first to the last quote, so it is
    enough to look between them for a repeated group or three repeated words in a row."""

    GROUP = DOTALL + r"\A[^(]*+\([^+*]*+[+*].*\)[+*]"
    # Three words each followed by a sign. The search starts at a sign, which is rarer than a letter.
    WORDS = rf"{DOTALL}[+*](?<={WORD}.){WORD}++[+*]{WORD}++[+*]"
    INSIDE = f"regexp_extract(content, {quoted(DOTALL + '''["'](.*)["']''')}, 1)"

    def hit(self) -> str:
        group, words = quoted(self.GROUP), quoted(self.WORDS)
        return (
            f"(({any_contains('content', (')+', ')*'))} AND rlike({self.INSIDE}, {group}))"
            f" OR (rlike(content, {words}) AND rlike({self.INSIDE}, {words})))"
        )

    def count(self) -> str:
        return "1"

    def before(self) -> str:
        return f"regexp_extract(content, {quoted(DOTALL + '''\\A([^"']*+)''')}, 1)"

    def evidence(self) -> str:
        return f"left(regexp_extract(content, {quoted(DOTALL + '''["'].*["']''')}, 0), {EVIDENCE_CHARS})"


def matcher(rule: Rule) -> Matcher:
    if rule.shape == "closed_by_paren":
        return ClosedBy(rule, r"\)")
    if rule.shape == "closed_by_quote":
        return ClosedBy(rule, "[\"']")
    if rule.shape == "braced_end":
        return OpenedInVain(rule, "{", r"\}")
    if rule.shape == "quote_to_last_brace":
        return OpenedInVain(rule, "\"'", r"\{")
    if rule.shape == "head_to_last":
        return HeadToLast(rule)
    if rule.shape == "quoted_nested_repeat":
        return QuotedNestedRepeat(rule)
    return Matcher(rule)
