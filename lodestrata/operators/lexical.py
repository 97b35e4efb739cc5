"""Code text read character by character: what is string, comment or bracket, and which scopes nest.

A file's text is one row, and nesting is not a regular language, so this is a map over Arrow batches:
one pass per file with a stack, linear in the text, no shuffle. It gives two things.

The shielded text has the same length and the same places, in which every sign that means
nothing there is replaced by one of its own in a private area: signs of strings and comments, line
ends and colons inside brackets, and brackets deeper than ``DEEP``. So a header over several lines is one
line, and patterns see syntax only. ``plain`` takes the signs back.

``scopes`` and ``guards`` are what a stack over that text finds: Python scopes end before the
next code line that is indented no deeper, script scopes at their closing brace.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ship the pass with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHIELD = {ord(c): 0xE000 + ord(c) for c in "()[]{}:;,=#@\n\"'`"}
_PLAIN = "".join(map(chr, SHIELD))
_SHIELDED = "".join(map(chr, SHIELD.values()))
#: An ordinary line end and one inside brackets, strings or comments.
LINE_ENDS = "\n" + chr(SHIELD[10])
#: Brackets inside this many others are shielded, so that patterns need to follow fewer levels than text may have.
DEEP = 16
PREVIEW = 120

# Header words of a scope and the label each gives.
# The last group is the colon that ends the header, where its brackets hold no others.
PY_HEADER = re.compile(r"([ \t]*)(?:(async)[ \t]+)?(class|def|if|elif|else|for|while|try|except|finally|with)\b[ \t]*([A-Za-z_]\w*)?"
                       r"(?:(?:[^()\[\]{}:]++|:(?==)|\([^()\[\]{}]*+\)|\[[^()\[\]{}]*+\])*+(:))?")
# (pattern, groups, words of which every match holds one).
JS_HEADERS = [(re.compile(pattern), groups, needs) for pattern, groups, needs in [
    (r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(class|interface|enum|namespace)\s+(\w+)", (1, 2, None), ("class", "interface", "enum", "namespace")),
    (r"\s*(?:export\s+)?(?:default\s+)?(async\s+)?function\s*\*?\s*(\w+)\s*\(", ("function", 2, 1), ("function",)),
    (r"\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(async\s+)?\(.*=>\s*$", ("arrow fn", 1, None), ("=>",)),
    (r"\s*\}?\s*(if|else|for|while|switch|try|catch|finally)\b", (1, None, None), ()),
    (r"\s*(?:(?:async|static|public|private|protected|get|set)\s+)*(\w+)\s*\([^;]*\)(?:\s*:[^=;]*)?\s*$", ("method", 1, None), ("(",))]]
NAMED = {"class", "def", "function", "method", "arrow fn", "interface", "enum", "namespace"}
NO_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "with", "do"}
FUNCTIONS = {"function", "method", "async function", "async method", "constructor"}
_RAISE = re.compile(r"(?:^|[:;])\s*raise\b[ \t]*([\w.]*)([^;]*)")
_THROW = re.compile(r"throw(?<=\bthrow)\s+(?:new\s+)?([\w.]+)([^;}\n]*)")


def _balanced(depth: int) -> str:
    return "[^()]*+" if not depth else rf"(?:[^()]++|\({_balanced(depth - 1)}\))*+"


_JS_IF = re.compile(rf"if(?<=\bif)\s*\(({_balanced(DEEP + 1)})\)")
_JS_SHORT_GUARD = re.compile(_JS_IF.pattern + r"\s*(?=throw\b)")
_QUOTED = re.compile(r"[\"'`]([^\"'`]+)")

# What a sign search may step over, because nothing in it is shielded: plain characters, strings of plain characters, and brackets
# (``STEP`` levels of them) that open and close within a line and hold only these.
STEP = 3
_PLAIN_SIGNS = r"[^()\[\]{}:;,=#@\n\"'`\\]"


def _steps(string: str, inner: str, pairs: tuple[str, ...]) -> str:
    """Alternatives for a string of plain characters and for brackets of ``pairs`` around ``inner``, strings and each other."""
    held = f"{inner}++|{string}"
    for _ in range(STEP):
        brackets = "|".join(f"\\{a}(?:{held})*+\\{b}" for a, b in pairs)
        held = f"{inner}++|{string}|{brackets}"
    return f"{string}|{brackets}"


_PY_STRING = rf"\"(?!\"\"){_PLAIN_SIGNS}*+\"|'(?!''){_PLAIN_SIGNS}*+'"
_PY_STEPS = _steps(_PY_STRING, r"[^\"'#()\[\]{}\n\\]", ("()", "[]", "{}"))
_PY_SIGN = r"(\"\"\"|'''|[\"'#()\[\]{}\n]|\\\n)?"
#: The next sign of Python text, or the end of it: outside of brackets, inside, inside as many that the next may be shielded.
_PY_TOP = re.compile(rf"(?:[^\"'#(\[{{\\]++|\\(?!\n)|{_PY_STEPS})*+{_PY_SIGN}")
_PY_INNER = re.compile(rf"(?:[^\"'#()\[\]{{}}\n\\]++|\\(?!\n)|{_PY_STEPS})*+{_PY_SIGN}")
_PY_DEEP = re.compile(rf"(?:[^\"'#()\[\]{{}}\n\\]++|\\(?!\n))*+{_PY_SIGN}")
_JS_STRING = rf"\"{_PLAIN_SIGNS}*+\"|'{_PLAIN_SIGNS}*+'"
_JS_STEPS = _steps(_JS_STRING, r"[^()\[\]{}\"'`/\n]", ("()", "[]"))


def _js_search(plain_signs: str, steps: str, begins: str, signs: str) -> re.Pattern:
    """The next of ``signs``, in group 2; group 1 is what is stepped over up to the last sign that begins a statement or value."""
    over = f"(?:{plain_signs}++{steps})*+"
    return re.compile(f"((?:{over}{begins})*+){over}([{signs}])?")


_JS_TOP = _js_search(r"[^\"'`/(\[{};]", f"|{_JS_STEPS}", ";", r"\"'`/(\[{}")
_JS_INNER = _js_search(r"[^\"'`/()\[\]{}\n,]", f"|{_JS_STEPS}", ",", r"\"'`/()\[\]{}\n")
_JS_DEEP = _js_search(r"[^\"'`/()\[\]{}\n,]", "", ",", r"\"'`/()\[\]{}\n")
#: The rest of a brace that holds values and nothing to shield.
_JS_VALUES = re.compile(rf"(?:[^()\[\]{{}}\"'`/\n]++|{_JS_STEPS})*+\}}")
_JS_LITERAL = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/")
#: Signs after which a slash begins a regular expression.
_BEFORE_LITERAL = "(,=:[!&|?{};\n"
_ENDS = {'"""': re.compile(r'(?s)(?:[^\\"]|\\.|"(?!""))*+"""'), "'''": re.compile(r"(?s)(?:[^\\']|\\.|'(?!''))*+'''"),
         '"': re.compile(r'(?s)(?:[^\\"\n]|\\.)*+"'), "'": re.compile(r"(?s)(?:[^\\'\n]|\\.)*+'"),
         "`": re.compile(r"(?s)(?:[^\\`$]|\\.|\$(?!\{))*+(?:`|\$\{)")}
_PY_FRESH = re.compile(r"(?:async[ \t]+)?(?:def|class)[ \t]+\w+[ \t]*[(:]|@\w")
#: Words after which a brace holds values, not statements.
_VALUE = re.compile(r"(?:[=,?:(\[&|+]|\b(?:return|import|export|const|let|var|type|yield|throw|of|in|default|typeof))\s*$")
_VALUE_TAIL = 16


def plain(col: str | Column) -> Column:
    """A piece of shielded text as it is in the file."""
    return F.translate(F.col(col) if isinstance(col, str) else col, _SHIELDED, _PLAIN)


_CASE = re.compile(r"\b(?:case\b[^;{}]*|default)\s*:$")
_CLOSE = {"(": ")", "[": "]", "L": "}", "T": "}", "B": "}"}
_BACK = {b: a for a, b in SHIELD.items()}


class _Shielder:
    """Copies a text, with some stretches shielded; stretches must come in order."""

    def __init__(self, text: str):
        self.text, self.out, self.last = text, [], 0

    def hide(self, start: int, end: int) -> None:
        if end > start >= self.last:
            self.out += (self.text[self.last:start], self.text[start:end].translate(SHIELD))
            self.last = end

    def blank(self, start: int, end: int) -> None:
        if end > start >= self.last:
            self.out += (self.text[self.last:start], re.sub(r"[^\n]", " ", self.text[start:end]).translate(SHIELD))
            self.last = end

    def done(self) -> str:
        return "".join((*self.out, self.text[self.last:]))


def shield_python(text: str) -> str:
    copy, depth, at = _Shielder(text), 0, 0
    while True:
        sign = (_PY_INNER if depth <= DEEP - STEP else _PY_DEEP).match(text, at) if depth else _PY_TOP.match(text, at)
        s, at = sign.group(1), sign.end()
        if s is None:
            return copy.done()
        start = at - len(s)
        if s in _ENDS:
            if end := _ENDS[s].match(text, at):
                copy.hide(at, end.end() - len(s))
                at = end.end()
            elif len(s) == 3:
                copy.hide(at, len(text))
                return copy.done()
        elif s == "#":
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            copy.blank(start, end)
            at = end
        elif s in "([{":
            depth += 1
            if depth > DEEP:
                copy.hide(start, at)
        elif s in ")]}":
            if depth > DEEP:
                copy.hide(start, at)
            depth = max(0, depth - 1)
        elif s == "\n" and depth and _PY_FRESH.match(text, at):
            depth = 0  # a definition at the margin: the bracket was never closed
        elif depth or s == "\\\n":
            copy.hide(start, at)


def _literal(text: str, start: int) -> re.Match | None:
    """The regular expression that begins at a slash, if one does."""
    p = start
    while p and text[p - 1] in " \t":
        p -= 1
    return _JS_LITERAL.match(text, start) if p and text[p - 1] in _BEFORE_LITERAL else None


def shield_script(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The shielded text, and (start of the header, its brace, closing brace) of each block of statements."""
    copy, stack, blocks, at, begin = _Shielder(text), [], [], 0, 0
    # ``stack`` holds brackets: (sign, brackets since the last block, start of the statement, block number).

    def template(at: int) -> int:
        end = _ENDS["`"].match(text, at)
        if not end:
            copy.hide(at, len(text))
            return len(text)
        copy.hide(at, end.end())
        if end.group().endswith("{"):
            stack.append(("T", 1 + (stack[-1][1] if stack else 0), begin, 0))
        return end.end()

    while True:
        depth = stack[-1][1] if stack else 0
        sign = (_JS_INNER if depth <= DEEP - STEP else _JS_DEEP).match(text, at) if depth else _JS_TOP.match(text, at)
        s, at = sign.group(2), sign.end()
        if s is None:
            return copy.done(), blocks
        if sign.group(1):
            begin = sign.end(1)
        start = at - 1
        if s in "\"'":
            if end := _ENDS[s].match(text, at):
                copy.hide(at, end.end() - 1)
                at = end.end()
        elif s == "`":
            at = template(at)
        elif s == "/":
            after = text[at:at + 1]
            if after and after in "/*":
                end = text.find("\n" if after == "/" else "*/", at + 1)
                end = len(text) if end < 0 else end + 2 * (after == "*")
                copy.blank(start, end)
                at = end
            elif end := _literal(text, start):
                at = end.end()
                copy.hide(start, at)
        elif s == "{":
            p = start
            while p > begin and text[p - 1].isspace():
                p -= 1
            before = text[begin:p]
            statements = (before.endswith((")", "=>")) or before.endswith(":") and _CASE.search(before)
                          or not (depth or before and _VALUE.search(before[-_VALUE_TAIL:])))
            if statements:
                if "\n" in text[p:start]:
                    copy.hide(p, start)  # the brace stands on a line of its own
                blocks.append([begin, start, len(text)])
                stack.append(("B", 0, begin, len(blocks) - 1))
                begin = at
            elif depth < DEEP - STEP and (end := _JS_VALUES.match(text, at)):
                at = end.end()
            else:
                stack.append(("L", depth + 1, begin, 0))
                begin = at
                if depth >= DEEP:
                    copy.hide(start, at)
        elif s in "([":
            stack.append((s, depth + 1, begin, 0))
            begin = at
            if depth >= DEEP:
                copy.hide(start, at)
        elif s in ")]}":
            if s == "}":  # brackets that were never closed end with their block
                while stack and stack[-1][0] in "([":
                    stack.pop()
            if not stack or _CLOSE[stack[-1][0]] != s:
                continue  # closes nothing that is open
            kind, d, held, number = stack.pop()
            if kind == "B":
                blocks[number][2] = start
                begin = held if stack and stack[-1][1] else at
            elif kind == "T":
                copy.hide(start, at)
                at = template(at)
            else:
                begin = held
                if d > DEEP:
                    copy.hide(start, at)
        elif depth:
            copy.hide(start, at)


def _back(code: str) -> str:
    """A piece of shielded text as it is in the file."""
    return code if code.isascii() else code.translate(_BACK)


def _scope(word: str, name: str | None, is_async: bool, start: int, text: str, depth: int, parent: str | None, indent: int) -> dict:
    kind = {"def": "function", "catch": "except"}.get(word, word)
    if word in ("def", "function") and is_async:
        kind = "async function"
    if word == "method" and name == "constructor":
        kind = "constructor"
    if parent == "class":
        kind = {"function": "method", "async function": "async method"}.get(kind, kind)
    preview = _back(text.partition("\n")[0].partition(LINE_ENDS[1])[0]).strip()
    if len(preview) > PREVIEW:
        preview = preview[:PREVIEW - 3] + "..."
    return {"node_type": kind, "name": name if word in NAMED else None, "start_line": start, "end_line": start,
            "depth": depth, "parent_type": parent, "preview": preview, "indent": indent}


_IN_BRACKETS = re.compile(rf"\(\s*({_balanced(DEEP)})\s*\)")


def _guard(line: int, condition: str, holder: str | None) -> dict:
    condition = condition.replace(LINE_ENDS[1], " ").strip()
    while condition.startswith("(") and (whole := _IN_BRACKETS.fullmatch(condition)):
        condition = whole.group(1)
    return {"line": line, "function": holder or "anonymous", "condition": " ".join(_back(condition).split()),
            "error": None, "message": None, "found": False}


def _raises(guards: list[dict], error: str, rest: str) -> None:
    """A raise in the statement of each guard; the last one with a text gives the message."""
    quoted = _QUOTED.search(_back(rest))
    for guard in guards:
        if not guard["found"] or quoted:
            guard.update(found=True, error=error or None, message=quoted and quoted.group(1))


def _holder(open_scopes: list) -> str | None:
    return next((s["name"] for s in reversed(open_scopes) if s["node_type"] in FUNCTIONS), None)


def _colon(code: str) -> int:
    """Place of the colon that ends a header, -1 if there is none."""
    depth = 0
    for sign in re.finditer(r"[()\[\]{}]|:(?!=)", code):
        if sign.group() == ":":
            if not depth:
                return sign.start()
        else:
            depth += 1 if sign.group() in "([{" else -1
    return -1


_GOES_ON = re.compile(r"(?:elif|else)\b")
_HEADER_SIGNS = "acdefitw"


def outline_python(shielded: str, with_guards: bool = True) -> tuple[list[dict], list[dict]]:
    scopes, guards, stack, number, last = [], [], [], 1, 0
    # ``stack`` holds (indent, scope, guards of its if statement).
    shield_end = LINE_ENDS[1]
    chains: dict[int, list[dict]] = {}
    for text in shielded.split("\n"):
        start, number = number, number + 1 + text.count(shield_end)
        code = text.rstrip()
        body = code.lstrip(" \t")
        if not body:
            continue
        indent = len(code) - len(body)
        if "\t" in code:
            indent = len(code[:indent].expandtabs(4))
        while stack and stack[-1][0] >= indent:
            stack.pop()[1]["end_line"] = last
        last = number - 1
        if chains:
            chains = {i: c for i, c in chains.items() if i < indent or i == indent and _GOES_ON.match(body)}
        header = PY_HEADER.match(code) if body[0] in _HEADER_SIGNS else None
        colon = -1 if not header else _colon(code) if header.start(5) < 0 else header.start(5)
        if colon >= 0:
            _, is_async, word, name, _ = header.groups()
            scope = _scope(word, name, bool(is_async), start, body, len(stack), stack[-1][1]["node_type"] if stack else None, indent)
            chain = []
            if not with_guards:
                pass
            elif word in ("if", "elif"):
                guard = _guard(start, code[header.end(3):colon], _holder([s for _, s, _ in stack]))
                chain = [*(chains.get(indent, []) if word == "elif" else []), guard]
                guards.append(guard)
                chains[indent] = chain
            elif word == "else":
                chain = chains.get(indent, [])
            scopes.append(scope)
            stack.append((indent, scope, chain))
            scope["end_line"] = last
            body = code[colon:]
        if with_guards and "raise" in body:
            for found in _RAISE.finditer(body):
                _raises([g for _, _, chain in stack for g in chain], found.group(1), found.group(2))
    for _, scope, _ in stack:
        scope["end_line"] = last
    return scopes, [g for g in guards if g.pop("found")]


_LINE_END = re.compile(f"[{LINE_ENDS}]")


def outline_script(shielded: str, blocks: list, with_guards: bool = True) -> tuple[list[dict], list[dict]]:
    scopes, guards, stack = [], [], []  # stack: (closing place, scope or None, guard or None)
    ends = [m.start() for m in _LINE_END.finditer(shielded)]

    def line_of(place: int) -> int:
        return bisect_left(ends, place) + 1
    # Blocks, throws and short guards in the order of the text.
    events = [(brace, 0, begin, end) for begin, brace, end in blocks]
    if with_guards and "throw" in shielded:
        events += [(m.start(), 1, m, None) for m in _THROW.finditer(shielded)]
        events += [(m.start(), 2, m, None) for m in _JS_SHORT_GUARD.finditer(shielded)]
    short = (-1, None)
    for place, kind, what, end in sorted(events, key=lambda e: e[:2]):
        while stack and stack[-1][0] < place:
            stack.pop()
        held = [s for _, s, _ in stack if s]
        if kind == 1:
            guard = short[1] if short[0] == place else stack[-1][2] if stack else None
            _raises([guard] if guard else [], what.group(1), what.group(2))
        elif kind == 2:
            guards.append(_guard(line_of(place), what.group(1), _holder(held)))
            short = what.end(), guards[-1]
        else:
            head = _header(shielded[what:place]).replace(LINE_ENDS[1], " ")
            body = head.lstrip()
            first = place - len(body)
            scope = guard = None
            for pattern, groups, needs in JS_HEADERS if body else ():
                if (not needs or any([n in head for n in needs])) and (found := pattern.match(head)):
                    word, name, is_async = [found.group(g) if isinstance(g, int) else g for g in groups]
                    if word == "method" and (name in NO_METHODS or head.count("(") != head.count(")")):
                        break
                    margin = shielded.rfind("\n", 0, first) + 1
                    before = shielded[margin:first]
                    line_end = shielded.find("\n", place)
                    scope = _scope(word, name, bool(is_async), line_of(first),
                                   shielded[first:line_end if line_end >= 0 else len(shielded)], len(held),
                                   held[-1]["node_type"] if held else None, 0 if before.strip() else len(before.expandtabs(4)))
                    scope["end_line"] = line_of(end)
                    scopes.append(scope)
                    if with_guards and word in ("if", "else") and (condition := _JS_IF.search(body)):
                        guard = _guard(scope["start_line"], condition.group(1), _holder(held))
                        guards.append(guard)
                    break
            if not body and stack:
                guard = stack[-1][2]  # a block by itself belongs to what holds it
            stack.append((end, scope, guard))
    return scopes, [g for g in guards if g.pop("found")]


def import_runs(shielded: str) -> list[dict]:
    """Runs of two or more import statements; blank lines and comments may lie between them."""
    runs, run, number = [], None, 1
    for text in shielded.split("\n"):
        start, number = number, number + 1 + text.count(LINE_ENDS[1])
        code = text.strip()
        if not code:
            continue
        if not re.match(r"(?:import|from)\s", code):
            run = None
            continue
        end = start + text.rstrip().count(LINE_ENDS[1])
        if run is None:
            run = {"start_line": start, "end_line": end, "import_count": 0}
            runs.append(run)
        run.update(end_line=end, import_count=run["import_count"] + 1)
    return [r for r in runs if r["import_count"] > 1]


_BASES = re.compile(r"\s*(?:extends|implements)\b")


def _header(text: str) -> str:
    """The header at the end of what stands before a brace: its last line, and those that it goes on from."""
    last = text[text.rfind("\n") + 1:]
    if not _BASES.match(last):
        return last
    lines = text.split("\n")
    at = len(lines) - 1
    while at and _BASES.match(lines[at]):
        at -= 1
    return "\n".join(lines[at:])


_SCOPE = pa.struct([("node_type", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()),
                    ("depth", pa.int32()), ("parent_type", pa.string()), ("preview", pa.string()), ("indent", pa.int32())])
_GUARD = pa.struct([("line", pa.int32()), ("function", pa.string()), ("condition", pa.string()), ("error", pa.string()),
                    ("message", pa.string())])
_RUN = pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("import_count", pa.int64())])
_NESTED = {"scopes": "scopes array<struct<node_type:string,name:string,start_line:int,end_line:int,depth:int,parent_type:string,"
                     "preview:string,indent:int>>",
           "guards": "guards array<struct<line:int,function:string,condition:string,error:string,message:string>>"}


def shield(language: str | None, text: str) -> tuple[str, list]:
    text = text.replace("\r\n", " \n")
    return (shield_python(text), []) if language == "python" else shield_script(text)


#: Signs that match_pieces takes out of a text before it looks for matches.
_MARKS = re.compile("[\1\2]")
_ODD_ENDS = "\r\x85\u2028\u2029"
_ODD_END = re.compile(f"[{_ODD_ENDS}]")
_WITHIN_END = "(?!(?<=\r)\n)"


def _compiled(pattern: str, odd_ends: bool) -> re.Pattern:
    """A pattern of Java's regex as Spark runs it: letters, digits and blanks are ASCII, and ``(?m)^`` at the start
    and ``$`` at the end of the pattern know Java's line ends (``odd_ends`` says that a text has others than \\n)."""
    if pattern.startswith("(?m)^"):
        pattern = (f"(?:\\A|(?<=[{_ODD_ENDS}\n]){_WITHIN_END})" if odd_ends else "(?m:^)") + pattern[5:]
    if pattern.endswith("$"):
        pattern = pattern[:-1] + (f"(?=[{_ODD_ENDS}\n]|\\Z){_WITHIN_END}" if odd_ends else "(?=\n|\\Z)")
    return re.compile(pattern, re.ASCII)


def _lists(rows: list[list[dict]], kind: pa.StructType) -> pa.ListArray:
    """Lists of dicts, whose values are in the order of the fields, as an array."""
    columns = list(zip(*[d.values() for row in rows for d in row])) or [()] * kind.num_fields
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), pa.StructArray.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind)))


def read(files: DataFrame, patterns: dict[str, tuple[str, str, list[str]]], with_scopes: bool = False, with_guards: bool = False) -> DataFrame:
    """path, language and what one pass over the file finds: ``scopes`` and ``guards`` if asked for, and the matches of each pattern.

    ``patterns`` gives by column name (family, pattern, names of its groups), the family being python or script. The
    matches in the shielded content are ARRAY<STRUCT<line,groups...>>; empty groups are null, a file of another
    family has an empty array.
    """
    with_nested = with_scopes or with_guards
    names, groups = list(patterns), [g for _, _, g in patterns.values()]
    members = {f: [i for i, p in enumerate(patterns.values()) if p[0] == f] for f in ("python", "script")}
    family = {"python": members["python"], "javascript": members["script"], "typescript": members["script"]}
    forms = [p for _, p, _ in patterns.values()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [tuple(_compiled(p, odd) for odd in (False, True)) for p in forms]
        for batch in batches:
            scopes, guards = [], []
            ends = [[0] for _ in names]
            lines = [[] for _ in names]
            texts = [[[] for _ in g] for g in groups]
            for lang, text in zip(*(batch.column(i).to_pylist() for i in (1, 2))):
                wanted = family.get(lang, ())
                code, blocks = shield(lang, text or "") if with_nested or wanted else ("", [])
                if with_nested:
                    found = outline_python(code, with_guards) if lang == "python" else outline_script(code, blocks, with_guards)
                    scopes.append(found[0])
                    guards.append(found[1])
                if wanted and ("\1" in code or "\2" in code):
                    code = _MARKS.sub("", code)
                odd = _ODD_END.search(code) is not None
                for i in wanted:
                    line, last = 1, 0
                    for m in compiled[i][odd].finditer(code):
                        at = m.start()
                        line += code.count(LINE_ENDS[0], last, at) + code.count(LINE_ENDS[1], last, at)
                        last = at
                        lines[i].append(line)
                        for column, value in zip(texts[i], m.groups()):
                            column.append(value or None)
                for end, held in zip(ends, lines):
                    end.append(len(held))
            arrays = [*([_lists(scopes, _SCOPE)] if with_scopes else []), *([_lists(guards, _GUARD)] if with_guards else [])]
            arrays += [pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(held, pa.int32()), *(pa.array(c, pa.string()) for c in columns)], ["line", *g]))
                for end, held, columns, g in zip(ends, lines, texts, groups)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=columns_out)

    kept = {"scopes": with_scopes, "guards": with_guards}
    columns_out = ["path", "language", *(k for k in kept if kept[k]), *names]
    kinds = [f"{n} array<struct<line:int,{','.join(f'{x}:string' for x in g)}>>" for n, g in zip(names, groups)]
    return files.select("path", "language", "content").mapInArrow(
        run, ", ".join(["path string, language string", *(_NESTED[k] for k in kept if kept[k]), *kinds]))


def matched(files: DataFrame, patterns: dict[str, tuple[str, str, list[str]]]) -> DataFrame:
    """path, language and the matches of each pattern (see :func:`read`); taken from the columns of ``files`` if they are there."""
    if set(patterns) <= set(files.columns):
        return files.select("path", "language", *patterns)
    return read(files, patterns)


def import_blocks(files: DataFrame) -> DataFrame:
    """path and the file's runs of imports as an array."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [import_runs(shield(lang, t or "")[0]) for lang, t in zip(*(batch.column(i).to_pylist() for i in (1, 2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(_RUN))], names=["path", "runs"])

    return files.select("path", "language", "content").mapInArrow(
        run, "path string, runs array<struct<start_line:int,end_line:int,import_count:long>>")


def nested(files: DataFrame, kind: str) -> DataFrame:
    """path, language, and the file's ``scopes`` or ``guards`` as an array; taken from the column of ``files`` if it is there."""
    if kind in files.columns:
        return files.select("path", "language", kind)
    return read(files, {}, with_scopes=kind == "scopes", with_guards=kind == "guards")
