"""Parsers of single files: a source text becomes fact tuples.

Python has a true grammar (the standard library's). The others read tokens and braces, which approximates a grammar:
macros, operators as functions and the like are not understood. A call is recorded and its arguments are not looked into.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

FACT_FIELDS = "fact_id bigint, kind string, name string, usr string, start_line bigint, start_col bigint, end_line bigint, end_col bigint, parent_id bigint"
Fact = tuple


@dataclass
class Facts:
    """Facts in order, with the stack of containers that are open."""

    rows: list[list] = field(default_factory=list)
    chain: bool = False
    last: int | None = None

    def add(self, kind: str, name: str | None, start: tuple[int, int], end: tuple[int, int], parent: int | None) -> int:
        if self.chain and self.last is not None and kind != "CallSite":
            parent = self.last
        self.rows.append([len(self.rows), kind, name, None, start[0], start[1], max(end[0], start[0]), end[1], parent])
        if kind in ("Function", "Class"):
            self.last = len(self.rows) - 1
        return len(self.rows) - 1

    def tuples(self) -> list[Fact]:
        """The facts as tuples, made in place."""
        for k, row in enumerate(self.rows):
            self.rows[k] = tuple(row)
        return self.rows


class PassingFacts(Facts):
    """Facts of which only functions and classes that are open are kept; the others are ready, as tuples."""

    def __init__(self, chain: bool = False):
        super().__init__({}, chain)
        self.ready: list[Fact] = []
        self.count = 0

    def add(self, kind: str, name: str | None, start: tuple[int, int], end: tuple[int, int], parent: int | None) -> int:
        if self.chain and self.last is not None and kind != "CallSite":
            parent = self.last
        row, k = [self.count, kind, name, None, start[0], start[1], max(end[0], start[0]), end[1], parent], self.count
        self.count += 1
        if kind in ("Function", "Class"):
            self.last, self.rows[k] = k, row
        else:
            self.ready.append(tuple(row))
        return k

    def close(self, k: int) -> None:
        self.ready.append(tuple(self.rows.pop(k)))

    def taken(self) -> list[Fact]:
        ready, self.ready = self.ready, []
        return ready


#: Characters of a Python source that are read as one tree; longer ones are cut between statements.
PIECE = 1 << 19
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_BLANK = re.compile(r"[ \t\f]*(?:#[^\r\n]*)?[\r\n]*\Z")


_GOES_ON = re.compile(r"[ \t\f#\r\n)\]}]|\Z|(?:else|elif|except|finally)\b")
_CLASS = re.compile(r"class[ \t]+\w+[ \t]*(?:\([^#\"'\r\n]*\))?[ \t]*:[ \t]*[\r\n]+\Z")


def _groups(lines: list[str], first: int, end: int, indent: str) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of lines that begin at that indent: about PIECE characters or one statement, and from each class on."""
    start, size = first, 0
    for k in range(first, end):
        line = lines[k]
        if size and line.startswith(indent) and (size >= PIECE or line.startswith("class", len(indent))):
            if not _GOES_ON.match(line, len(indent)) and not lines[k - 1].startswith(indent + "@"):
                yield start, k
                start, size = k, 0
        size += len(line)
    yield start, end


def _trees(lines: list[str], first: int, end: int, indent: str = "") -> Iterator[tuple[ast.AST | None, int, bool]]:
    """(tree, lines to add to its places, whether it only heads a class) of the statements between two lines; no tree ends such a class.

    Text that is whole statements on both sides of a cut has the same trees as in one piece; a cut anywhere else is an error of
    one side, and the caller reads the text whole. Long classes are cut within: first their heads, then their statements.
    """
    for a, b in _groups(lines, first, end, indent):
        head = a
        while head < b and _BLANK.match(lines[head]):
            head += 1
        if sum(map(len, lines[a:b])) > 2 * PIECE and head < b and lines[head].startswith(indent) and _CLASS.match(lines[head], len(indent)):
            body = head + 1
            while body < b and _BLANK.match(lines[body]):
                body += 1
            inner = re.match(r"[ \t]*", lines[body]).group() if body < b else ""
            if len(inner) > len(indent) and all(lines[k].startswith(inner) or _BLANK.match(lines[k]) for k in range(body, b)):
                yield ast.parse(_wrapped([lines[head], inner + "pass\n"], indent)), head - bool(indent), True
                yield from _trees(lines, body, b, inner)
                yield None, 0, False
                continue
        yield ast.parse(_wrapped(lines[a:b], indent)), a - bool(indent), False


def _wrapped(lines: list[str], indent: str) -> str:
    return ("if 1:\n" if indent else "") + "".join(lines)


def parse_python(source: str, detailed: bool = False, sibling_chaining: bool = False) -> list[Fact]:
    """Functions, classes, lambdas (named lambda), calls by the text of what is called; names too if detailed.

    Long sources are read in pieces of whole statements, so that memory goes with the facts, not with the trees.
    """
    lines = _LINE.findall(source)
    if len(source) > 2 * PIECE:
        try:
            return _python_facts(lines, _trees(lines, 0, len(lines)), detailed, sibling_chaining)
        except SyntaxError:
            pass  # a piece that is no whole statement, or an error that the whole source shows
    return _python_facts(lines, iter([(ast.parse(source), 0, False)]), detailed, sibling_chaining)


def _python_facts(lines: list[str], trees: Iterator, detailed: bool, sibling_chaining: bool) -> list[Fact]:
    out = Facts(chain=sibling_chaining)
    shift = 0

    def span(node: ast.AST) -> tuple[tuple[int, int], tuple[int, int]]:
        return (node.lineno + shift, node.col_offset), (node.end_lineno + shift, node.end_col_offset)

    def text(node: ast.AST) -> str:
        """The source of a node; columns are those of UTF-8 bytes."""
        (first, a), (last, b) = span(node)
        rows = [line.encode() for line in lines[first - 1 : last]]
        rows[-1] = rows[-1][:b]
        rows[0] = rows[0][a:]
        return b"".join(rows).decode()

    def visit(node: ast.AST, parent: int | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                visit(child, out.add("Function", child.name, *span(child), parent))
            elif isinstance(child, ast.ClassDef):
                visit(child, out.add("Class", child.name, *span(child), parent))
            elif isinstance(child, ast.Lambda):
                visit(child, out.add("Function", "lambda", *span(child), parent))
            elif isinstance(child, ast.Call):
                out.add("CallSite", text(child.func), *span(child), parent)
            elif detailed and isinstance(child, ast.Name):
                out.add("Variable", child.id, *span(child), parent)
            else:
                visit(child, parent)

    above: list[int] = []
    ending = (0, 0)
    for tree, shift, heads in trees:
        if tree is None:
            out.rows[above.pop()][6:8] = ending
            continue
        here = len(out.rows)
        visit(tree, above[-1] if above else None)
        if heads:
            above.append(here)
        elif tree.body:
            ending = span(tree.body[-1])[1]
    return out.tuples()


@dataclass(slots=True)
class Token:
    text: str
    line: int
    col: int


_SKIP = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])'"
_BRACED = re.compile(rf"(?P<skip>{_SKIP})|(?P<token>[A-Za-z_~][A-Za-z0-9_]*|::|->|[^\sA-Za-z0-9_])|(?P<number>[0-9][A-Za-z0-9_.]*)", re.S)


# C++ reads literals as tokens too, which declarations end with, and leaves preprocessor lines out.
_CPP = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?\*/|(?m:^)[ \t]*\#(?:\\\r?\n|[^\n])*)|(?P<token>[A-Za-z_~][A-Za-z0-9_]*|::|->|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'|[0-9](?:[A-Za-z0-9_.]|'(?=[0-9]))*|[^\sA-Za-z0-9_])", re.S
)


def _scan(source: str, pattern: re.Pattern) -> Iterator[Token]:
    line, start, at = 1, 0, 0
    for m in pattern.finditer(source):
        newlines = source.count("\n", at, m.start())
        if newlines:
            line, start = line + newlines, source.rfind("\n", 0, m.start()) + 1
        at = m.start()
        if m.lastgroup == "token":
            yield Token(m.group(), line, m.start() - start)


class Tokens:
    """The tokens of a source by their number, read when they are asked for and forgotten after their statement."""

    def __init__(self, source: str, pattern: re.Pattern):
        self.source, self.rows, self.first = _scan(source, pattern), [], 0
        self.watch: Callable[[int, Token], None] | None = None  # is told of every token that is read

    def more(self) -> bool:
        t = next(self.source, None)
        if t is None:
            return False
        self.rows.append(t)
        if self.watch is not None:
            self.watch(self.first + len(self.rows) - 1, t)
        return True

    def has(self, k: int) -> bool:
        while k - self.first >= len(self.rows):
            if not self.more():
                return False
        return True

    def __getitem__(self, k: int) -> Token:
        at = k - self.first
        if at < len(self.rows) or self.has(k):
            return self.rows[at]
        raise IndexError(k)

    def known(self) -> int:
        """The number of tokens read so far: of all, once has() was false."""
        return self.first + len(self.rows)

    def forget(self, k: int) -> bool:
        """Drop the tokens before k when they have become many."""
        many = k - self.first > 4096
        if many:
            del self.rows[: k - self.first]
            self.first = k
        return many


# Words that are followed by a parenthesis or brace without being calls or definitions.
CONTROL = {"if", "for", "while", "switch", "catch", "return", "sizeof", "else", "do", "match", "loop", "unsafe", "move", "in", "new", "delete", "throw", "go", "defer", "select", "case", "func", "fn", "let", "range"}
# Those of them that are plain names in C++.
_NAMES_IN_CPP = {"match", "loop", "unsafe", "move", "in", "go", "defer", "select", "func", "fn", "let", "range"}
_CPP_CONTROL = CONTROL - _NAMES_IN_CPP
# Words that begin a class-like definition.
CLASS_WORDS = {"cpp": {"class", "struct", "union", "interface"}, "rust": {"struct", "enum", "union", "trait", "impl"}, "go": set()}


def _word(t: Token) -> bool:
    return t.text[0].isalpha() or t.text[0] in "_~"


def _close(tokens: Tokens, i: int, pair: str = "()") -> int:
    """Index of the bracket that closes the one at i, or the last token."""
    depth, k = 0, i
    while tokens.has(k):
        depth += (tokens[k].text == pair[0]) - (tokens[k].text == pair[1])
        if not depth:
            return k
        k += 1
    return k - 1


def _definition(tokens: Tokens, i: int, language: str, inside: bool) -> tuple[str, str, int] | None:
    """(kind, name, index after the header) of a definition that begins at token i."""
    word, more = tokens[i].text, tokens.has(i + 1)
    if language == "go" and word == "func" and more:
        k = i + 1
        if tokens[k].text == "(":
            k = _close(tokens, k) + 1
        return ("Function", tokens[k].text, k + 1) if tokens.has(k) and _word(tokens[k]) else None
    if language == "go" and word == "type" and tokens.has(i + 2) and tokens[i + 2].text in ("struct", "interface"):
        return "Class", tokens[i + 1].text, i + 3
    if language == "rust" and word == "fn" and more and _word(tokens[i + 1]):
        return "Function", tokens[i + 1].text, i + 2
    if word in CLASS_WORDS[language]:
        k = i + 1
        if tokens.has(k) and tokens[k].text == "<":
            k = _close(tokens, k, "<>") + 1
        if tokens.has(k) and _word(tokens[k]) and (language == "rust" or _opens(tokens, k + 1)):
            if word == "impl":
                j = k
                while tokens.has(j) and tokens[j].text not in ("{", ";"):
                    if tokens[j].text == "for" and tokens.has(j + 1):
                        k = j + 1
                        break
                    j += 1
            return "Class", tokens[k].text, k + 1
    if language == "cpp" and _word(tokens[i]) and word not in _CPP_CONTROL and more and tokens[i + 1].text == "(":
        k = _close(tokens, i + 1) + 1
        while tokens.has(k) and tokens[k].text in ("const", "noexcept", "override", "final", "&"):
            k += 1
        if tokens.has(k) and tokens[k].text == ":" and not inside:  # initialisers of a constructor
            while tokens.has(k) and tokens[k].text not in ("{", ";"):
                k += 1
        typed = i > 0 and (_word(tokens[i - 1]) or tokens[i - 1].text in ("*", "&", ">", "::"))
        if tokens.has(k) and (tokens[k].text == "{" or (tokens[k].text == ";" and not inside and typed)):
            return "Function", word, k
    return None


def _opens(tokens: Tokens, i: int) -> bool:
    while tokens.has(i):
        if tokens[i].text in ("{", ";", "(", ")", "=", ",", ">"):
            return tokens[i].text == "{"
        i += 1
    return False


def _chain(tokens: Tokens, i: int) -> str:
    """The name that ends at token i with what qualifies it."""
    parts = [tokens[i].text]
    while i >= 2 and tokens[i - 1].text in (".", "::", "->") and _word(tokens[i - 2]):
        parts = [tokens[i - 2].text, tokens[i - 1].text, *parts]
        i -= 2
    return "".join(parts)


# Words of C++ that may stand before or around a type, types of one word, words before a type's name, words that begin no declaration.
_QUALIFIERS = {"static", "const", "constexpr", "constinit", "consteval", "extern", "inline", "mutable", "register", "thread_local", "volatile", "virtual", "explicit"}
_BUILT_IN = {"unsigned", "signed", "long", "short", "int", "char", "bool", "float", "double", "void", "auto", "wchar_t", "char8_t", "char16_t", "char32_t"}
_ELABORATED = {"struct", "class", "union", "enum", "typename"}
_NO_DECLARATION = {
    "asm", "break", "case", "catch", "co_await", "co_return", "co_yield", "continue", "default", "delete", "do", "else", "for", "friend", "goto", "if", "namespace", "new", "not", "operator",
    "private", "protected", "public", "return", "sizeof", "static_assert", "switch", "template", "this", "throw", "try", "typedef", "using", "while",
}


class Declarations:
    """Variables and parameters among C++ tokens: specifiers, then declarators with their initialisers.

    Without a symbol table, `a * b;` is a declaration, `a(b);` a call, and `T x(y);` a variable inside functions only.
    """

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.pair, self.closed_angle = {}, {}  # of those that are closed; -1: no template arguments
        self.opened: list[tuple[int, str]] = []
        tokens.watch = self.seen

    def seen(self, k: int, t: Token) -> None:
        kind, opened = t.text, self.opened
        if kind in ("(", "[", "{"):
            opened.append((k, kind))
        elif kind in (")", "]", "}"):
            self._drop_angles()
            if opened:
                self.pair[opened.pop()[0]] = k
        elif kind == "<":
            opened.append((k, kind))
            if k and self.tokens[k - 1].text == "<":  # a shift
                self._drop_angles()
        elif kind == ">" and opened and opened[-1][1] == "<":
            self.closed_angle[opened.pop()[0]] = k
        elif kind in (";", "=", "->", "|", "?"):
            self._drop_angles()

    def _drop_angles(self) -> None:
        while self.opened and self.opened[-1][1] == "<":
            self.closed_angle[self.opened.pop()[0]] = -1

    def forget(self, k: int) -> None:
        if self.tokens.forget(k):
            self.pair, self.closed_angle = ({a: b for a, b in t.items() if a >= k} for t in (self.pair, self.closed_angle))

    def text(self, k: int) -> str:
        tokens = self.tokens
        at = k - tokens.first
        return tokens.rows[at].text if at < len(tokens.rows) or tokens.has(k) else ""

    def after(self, k: int) -> int:
        """Index after the bracket that closes the one at k."""
        while k not in self.pair and self.tokens.more():
            pass
        return self.pair[k] + 1 if k in self.pair else self.tokens.known() + 1

    def word(self, k: int) -> bool:
        return self.tokens.has(k) and _word(self.tokens[k]) and self.text(k)[0] != "~" and self.text(k) not in _NO_DECLARATION

    def angle(self, k: int) -> int | None:
        """Index after the template arguments that open at k, None if it is a comparison or shift."""
        while k not in self.closed_angle and self.tokens.more():
            pass
        closed = self.closed_angle.get(k, -1)
        return closed + 1 if closed >= 0 else None

    def named(self, k: int) -> tuple[int, int]:
        """(index of the last word, index after) of a qualified name that begins at k."""
        while True:
            last, k = k, k + 1
            if self.text(k) == "<":
                k = self.angle(k) or k
            if self.text(k) != "::" or not self.word(k + 1):
                return last, k
            k += 1

    def specifiers(self, k: int) -> int | None:
        """Index after the words that name a type, None without any."""
        typed = False
        while True:
            t = self.text(k)
            if t == "[" and self.text(k + 1) == "[":
                k = self.after(k)
            elif t in _QUALIFIERS:
                k += 1
            elif t in _BUILT_IN:
                typed, k = True, k + 1
            elif not typed and (t in _ELABORATED or t == "::") and self.word(k + 1):
                k += 1
            elif not typed and self.word(k):
                typed, k = True, self.named(k)[1]
            else:
                return k if typed else None

    def declarator(self, k: int, abstract: bool) -> tuple[int | None, int] | None:
        """(index of the name, index after the declarator); the name may be missing if abstract."""
        while self.text(k) in ("*", "&", "const", "volatile") or (abstract and self.text(k) == "."):
            k += 1
        if self.text(k) == "(" and (self.text(k + 1) in ("*", "&") or self.text(k + 2) == "::"):
            inner = k + 1
            while self.text(inner + 1) == "::":  # a pointer to a member
                inner += 2
            found = self.declarator(inner, abstract)
            if found is None or self.text(found[1]) != ")" or self.text(found[1] + 1) not in ("(", "["):
                return None
            name, k = found[0], found[1] + 1
        elif self.word(k) and self.text(k) not in _BUILT_IN:
            name, k = self.named(k)
            if self.text(k) == "(" and not abstract:
                return name, k
        elif abstract:
            name = None
        else:
            return None
        while self.text(k) in ("[", "("):
            k = self.after(k)
        return name, k

    def expression(self, k: int) -> int:
        """Index of the comma, semicolon or bracket that ends an initialiser."""
        while self.tokens.has(k) and self.text(k) not in (",", ";", ")", "}", "]"):
            t, skipped = self.text(k), None
            if t == "<" and k and _word(self.tokens[k - 1]):
                skipped = self.angle(k)
                if self.text(skipped or k) not in ("(", "{", "::"):
                    skipped = None
            k = self.after(k) if t in ("(", "[", "{") else skipped or k + 1
        return k

    def variables(self, i: int, inside: bool, condition: str = "") -> tuple[list[tuple[int, int]], set[int]] | None:
        """(name, last token) of each declarator of a declaration that begins at i, and the tokens that are no calls.

        inside: in a function, where parentheses after a name hold its initialiser. condition: the word before the
        parenthesis that the declaration opens.
        """
        k = self.specifiers(i)
        if k is None:
            return None
        found, quiet = [], set(range(i, k))
        if self.text(k) in ("[", "&") and self.text(k - 1) == "auto" and self.text(k + (self.text(k) == "&")) == "[":
            k += self.text(k) == "&"
            end = self.after(k)
            names = [j for j in range(k + 1, end - 1) if self.word(j)]
            stop = self.expression(end + 1) if self.text(end) == "=" else end
            return ([(j, stop - 1) for j in names], quiet) if self.text(end) in ("=", ":", "{") else None
        while True:
            declared = self.declarator(k, abstract=False)
            if declared is None:
                return None
            name, k = declared
            quiet |= set(range(name, k))
            t, given = self.text(k), False
            if t == "(" and inside:
                k, given = self.after(k), True
            elif t == "{":
                k, given = self.after(k), True
            elif t == "=":
                k, given = self.expression(k + 1), True
            elif t == "(":
                return None
            found.append((name, k - 1))
            t = self.text(k)
            if t == ";" or (t == ")" and condition):
                return (found, quiet) if given or condition in ("", "for") else None
            if t == ":" and condition == "for":
                return found, quiet
            if t != ",":
                return None
            k += 1

    def parameters(self, k: int) -> Iterator[tuple[int | None, int, int]]:
        """(name, first token, last token) of the parameters in the parentheses that open at k."""
        end, a = self.after(k) - 1, k + 1
        while a < end:
            b, j = a, a
            while j < end and self.text(j) != ",":
                if self.text(j) == "<" and _word(self.tokens[j - 1]):
                    j = self.angle(j) or j + 1
                else:
                    j = self.after(j) if self.text(j) in ("(", "[", "{") else j + 1
            b, first = min(j, end), a
            a = b + 1
            if first == b or (b == first + 1 and self.text(first) == "void") or all(self.text(x) == "." for x in range(first, b)):
                continue
            after = self.specifiers(first)
            declared = self.declarator(after, abstract=True) if after is not None and after < b else None
            yield (declared[0] if declared and declared[1] <= b else None), first, b - 1


def parse_braced(source: str, language: str, sibling_chaining: bool = False, body_extent: bool = False) -> list[Fact]:
    """The facts of braced_facts in order."""
    return sorted(braced_facts(source, language, sibling_chaining, body_extent), key=lambda f: f[0])


def braced_facts(source: str, language: str, sibling_chaining: bool = False, body_extent: bool = False) -> Iterator[Fact]:
    """Functions, classes and calls of a C-like language: cpp, go or rust; for cpp variables and parameters too.

    A variable is each declarator outside classes, from where its declaration begins to the end of its initialiser,
    with the identifier as name; a parameter is unnamed ('') if it has none. Calls in initialisers are kept. With
    body_extent a function's place is that of its braces, as C++ front ends give it. Functions and classes come when they
    are closed, and only the tokens of the statement are kept, so memory does not grow with the source.
    """
    tokens, out = Tokens(source, _CPP if language == "cpp" else _BRACED), PassingFacts(sibling_chaining)
    declarations = Declarations(tokens) if language == "cpp" else None
    stack: list[tuple[int, int]] = []
    depth, waiting, i, functions = 0, None, 0, 0  # functions: those that are open
    control = _CPP_CONTROL if language == "cpp" else CONTROL
    begin, quiet = 0, set()  # where the statement began; tokens of declarators
    end_of = lambda k: (tokens[k].line, tokens[k].col + len(tokens[k].text))
    while tokens.has(i):
        t = tokens[i]
        parent = stack[-1][0] if stack else None
        if declarations is not None and waiting is None:
            before = tokens[i - 1].text if i else ";"
            labelled = before == ":" and i > 1 and (tokens[i - 2].text in ("public", "private", "protected", "default") or i > 2 and tokens[i - 3].text == "case")
            condition = tokens[i - 2].text if before == "(" and i > 1 and tokens[i - 2].text in ("for", "if", "while", "switch") else ""
            if before in (";", "{", "}") or labelled:
                begin = i
            if (begin == i or condition) and _word(t) and not (parent is not None and out.rows[parent][1] == "Class"):
                declared = declarations.variables(i, functions > 0, condition)
                for name, last in declared[0] if declared else ():
                    out.add("Variable", tokens[name].text, (t.line, t.col), end_of(last), parent)
                quiet = declared[1] if declared else set()
        if t.text == "{":
            depth += 1
            if waiting is not None:
                if body_extent and out.rows[waiting][1] == "Function":
                    out.rows[waiting][4:6] = t.line, t.col
                stack.append((waiting, depth))
                functions += out.rows[waiting][1] == "Function"
                waiting = None
        elif t.text == "}":
            if stack and stack[-1][1] == depth:
                closed = stack.pop()[0]
                row = out.rows[closed]
                functions -= row[1] == "Function"
                row[6], row[7] = t.line, t.col + 1
                out.close(closed)
            depth = max(0, depth - 1)
        elif t.text == ";" and waiting is not None:
            out.close(waiting)
            waiting = None
        elif i in quiet:
            pass
        elif _word(t) and (found := _definition(tokens, i, language, functions > 0)):
            kind, name, after = found
            first = tokens[begin] if declarations is not None and kind == "Function" else t
            waiting = out.add(kind, name, (first.line, first.col), end_of(after - 1 if tokens.has(after - 1) else tokens.known() - 1), parent)
            for k, a, b in declarations.parameters(i + 1) if declarations is not None and kind == "Function" else ():
                out.add("Parameter", "" if k is None else tokens[k].text, (tokens[a].line, tokens[a].col), end_of(b), waiting)
            i = after
            continue
        elif _word(t) and t.text not in control and tokens.has(i + 1) and waiting is None:
            macro = language == "rust" and tokens[i + 1].text == "!" and tokens.has(i + 2) and tokens[i + 2].text in "([{"
            if tokens[i + 1].text == "(" or macro:
                close = _close(tokens, i + 2, {"(": "()", "[": "[]", "{": "{}"}[tokens[i + 2].text]) if macro else _close(tokens, i + 1)
                name = _chain(tokens, i)
                out.add("CallSite", name, (t.line, t.col - max(0, len(name) - len(t.text))), (tokens[close].line, tokens[close].col + 1), parent)
                i = close
        if waiting is None and t.text in (";", "{", "}"):
            (declarations or tokens).forget(i - 3)
            if len(out.ready) > 1000:
                yield from out.taken()
        i += 1
    for k in list(out.rows):
        out.close(k)
    yield from out.taken()


_RUBY = re.compile(r"(?P<skip>\#[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|:[A-Za-z_]\w*)|(?P<token>->|[A-Za-z_][A-Za-z0-9_]*[?!]?|\n|[^\sA-Za-z0-9_])|(?P<number>[0-9][0-9_.]*)", re.S)
# Words of Ruby that open a block up to an end, and words that are no calls.
_RUBY_OPENS = {"def", "class", "module", "do", "begin", "case", "if", "unless", "while", "until", "for"}
_RUBY_WORDS = _RUBY_OPENS | {"end", "then", "else", "elsif", "when", "return", "self", "nil", "true", "false", "and", "or", "not", "yield", "in", "rescue", "ensure", "super"}


def parse_ruby(source: str, sibling_chaining: bool = False) -> list[Fact]:
    """Methods, classes, modules, lambdas, blocks and calls; a call is a name with parentheses or arguments, or after a dot."""
    tokens, out = list(_scan(source, _RUBY)), Facts(chain=sibling_chaining)
    stack: list[int | None] = []
    fresh = True
    for i, t in enumerate(tokens):
        parent = next((k for k in reversed(stack) if k is not None), None)
        after = tokens[i + 1] if i + 1 < len(tokens) else Token("\n", t.line, t.col)
        previous = tokens[i - 1].text if i else "\n"
        at = (t.line, t.col), (t.line, t.col + len(t.text))
        if t.text in ("def", "class", "module") and previous != ".":
            k = i + 1
            while k + 2 < len(tokens) and tokens[k + 1].text == ".":
                k += 2
            name = tokens[k].text if k < len(tokens) else None
            stack.append(out.add("Function" if t.text == "def" else "Class", name, *at, parent))
        elif t.text == "->":
            stack.append(out.add("Function", "lambda", *at, parent))
        elif t.text in ("do", "{") and not (stack and stack[-1] is not None and out.rows[stack[-1]][2] == "lambda" and out.rows[stack[-1]][6] == t.line and not fresh):
            loop = t.text == "do" and any(x.text in ("while", "until", "for") for x in tokens[max(0, i - 12) : i] if x.line == t.line)
            if not loop:
                hash_literal = t.text == "{" and previous in ("=", "(", ",", "[", "\n", "return")
                stack.append(None if hash_literal else out.add("Function", "block", *at, parent))
        elif t.text in ("begin", "case") or (t.text in ("if", "unless", "while", "until", "for") and previous in ("\n", "=", "{", ";")):
            stack.append(None)
        elif t.text in ("end", "}") and stack:
            closed = stack.pop()
            if closed is not None:
                out.rows[closed][6], out.rows[closed][7] = t.line, t.col + len(t.text)
        elif (t.text[0].isalpha() or t.text[0] == "_") and t.text not in _RUBY_WORDS and previous not in ("def", "class", "module", "<"):
            defined = previous == "." and i >= 3 and tokens[i - 3].text == "def"
            argument = after.line == t.line and after.text not in "\n=.,)]}+-*/<>|&;?:%!" and after.text not in _RUBY_WORDS
            starts = previous in ("\n", ";", "{", "=", "(", "do", "then", "else", "->")
            if not defined and (after.text == "(" or previous == "." or (starts and argument) or (starts and t.text[-1] in "?!") or (previous == "\n" and after.text == "\n" and t.text[0].islower())):
                out.add("CallSite", t.text, *at, parent)
        fresh = t.text != "->" and (fresh or t.text in ("{", "do"))
    return out.tuples()


def parse_clang(source: str) -> list[Fact]:
    """C++ facts as a compiler front end gives them: symbols for functions and classes, functions at their bodies."""
    return list(with_symbols(iter(parse_braced(source, "cpp", body_extent=True))))


Parser = Callable[[str], Iterable[Fact]]
_registry: dict[str, Parser] = {
    "Python": parse_python,
    "Cpp": lambda s: with_symbols(braced_facts(s, "cpp", body_extent=True)),
    "CppTreeSitter": lambda s: braced_facts(s, "cpp"),
    "Go": lambda s: braced_facts(s, "go"),
    "Rust": lambda s: braced_facts(s, "rust"),
    "Ruby": parse_ruby,
}


def register_parser(language: str, parser: Parser) -> None:
    """Use a parser of one's own for a language; it takes a source text and gives tuples as FACT_FIELDS says."""
    _registry[language] = parser


def registered() -> dict[str, Parser]:
    return dict(_registry)


#: What a text that does not parse raises.
PARSE_ERRORS = (SyntaxError, ValueError, RecursionError)


def parsed(parser: Parser, source: str | None) -> tuple[list[Fact], str | None]:
    """(facts in order, error): a file that does not parse gives its error."""
    try:
        return sorted(parser(source or ""), key=lambda f: f[0] or 0), None
    except PARSE_ERRORS as e:
        return [], f"{type(e).__name__}: {e}"


def with_symbols(facts: Iterator[Fact]) -> Iterator[Fact]:
    """Facts with a made-up usr for functions and classes, in the form that C++ front ends give."""
    for f in facts:
        yield (*f[:3], {"Function": f"c:@F@{f[2]}#", "Class": f"c:@S@{f[2]}"}.get(f[1]), *f[4:])
