"""Lexer for Verilog / SystemVerilog source text.

Comments, white space and compiler directives are trivia.  Conditional compilation,
macros with and without arguments and included files are resolved; the tokens of a macro
or an included file stand at the place of use.  Lines end at line feeds only; columns
count characters from 1, and a tab is one column.
"""

from __future__ import annotations

import posixpath
import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    col: int
    end_col: int  # column after the last character
    start: int = -1  # characters of the text, -1 if the token is not in it
    stop: int = -1


# Token kinds of keywords and operators, as the public SystemVerilog syntax names them.
KEYWORDS = {
    "always": "AlwaysKeyword", "always_comb": "AlwaysCombKeyword", "always_ff": "AlwaysFFKeyword", "always_latch": "AlwaysLatchKeyword",
    "assign": "AssignKeyword", "automatic": "AutomaticKeyword", "begin": "BeginKeyword", "bit": "BitKeyword", "break": "BreakKeyword",
    "byte": "ByteKeyword", "case": "CaseKeyword", "casex": "CaseXKeyword", "casez": "CaseZKeyword", "class": "ClassKeyword", "const": "ConstKeyword",
    "continue": "ContinueKeyword", "deassign": "DeassignKeyword", "default": "DefaultKeyword", "defparam": "DefParamKeyword", "disable": "DisableKeyword",
    "do": "DoKeyword", "edge": "EdgeKeyword", "else": "ElseKeyword", "end": "EndKeyword", "endcase": "EndCaseKeyword", "endclass": "EndClassKeyword",
    "endfunction": "EndFunctionKeyword", "endgenerate": "EndGenerateKeyword", "endinterface": "EndInterfaceKeyword", "endmodule": "EndModuleKeyword",
    "endpackage": "EndPackageKeyword", "endprogram": "EndProgramKeyword", "endspecify": "EndSpecifyKeyword", "endtask": "EndTaskKeyword", "enum": "EnumKeyword",
    "event": "EventKeyword", "final": "FinalKeyword", "for": "ForKeyword", "force": "ForceKeyword", "foreach": "ForeachKeyword", "forever": "ForeverKeyword",
    "fork": "ForkKeyword", "function": "FunctionKeyword", "generate": "GenerateKeyword", "genvar": "GenVarKeyword", "if": "IfKeyword", "iff": "IffKeyword",
    "import": "ImportKeyword", "initial": "InitialKeyword", "inout": "InOutKeyword", "input": "InputKeyword", "inside": "InsideKeyword", "int": "IntKeyword",
    "integer": "IntegerKeyword", "interface": "InterfaceKeyword", "join": "JoinKeyword", "join_any": "JoinAnyKeyword", "join_none": "JoinNoneKeyword",
    "localparam": "LocalParamKeyword", "logic": "LogicKeyword", "longint": "LongIntKeyword", "modport": "ModPortKeyword", "module": "ModuleKeyword",
    "negedge": "NegEdgeKeyword", "or": "OrKeyword", "output": "OutputKeyword", "package": "PackageKeyword", "packed": "PackedKeyword",
    "parameter": "ParameterKeyword", "posedge": "PosEdgeKeyword", "priority": "PriorityKeyword", "program": "ProgramKeyword", "real": "RealKeyword",
    "realtime": "RealTimeKeyword", "ref": "RefKeyword", "reg": "RegKeyword", "release": "ReleaseKeyword", "repeat": "RepeatKeyword", "return": "ReturnKeyword",
    "shortint": "ShortIntKeyword", "shortreal": "ShortRealKeyword", "signed": "SignedKeyword", "specify": "SpecifyKeyword", "static": "StaticKeyword",
    "string": "StringKeyword", "struct": "StructKeyword", "supply0": "Supply0Keyword", "supply1": "Supply1Keyword", "task": "TaskKeyword", "time": "TimeKeyword",
    "tri": "TriKeyword", "tri0": "Tri0Keyword", "tri1": "Tri1Keyword", "triand": "TriAndKeyword", "trior": "TriOrKeyword", "typedef": "TypedefKeyword",
    "union": "UnionKeyword", "unique": "UniqueKeyword", "unique0": "Unique0Keyword", "unsigned": "UnsignedKeyword", "uwire": "UWireKeyword", "var": "VarKeyword",
    "void": "VoidKeyword", "wait": "WaitKeyword", "wand": "WAndKeyword", "while": "WhileKeyword", "wire": "WireKeyword", "wor": "WOrKeyword",
}
OPERATORS = {
    "<<<=": "TripleLeftShiftEqual", ">>>=": "TripleRightShiftEqual", "<<<": "TripleLeftShift", ">>>": "TripleRightShift", "===": "TripleEquals", "!==": "ExclamationDoubleEquals",
    "==?": "DoubleEqualsQuestion", "!=?": "ExclamationEqualsQuestion", "<<=": "LeftShiftEqual", ">>=": "RightShiftEqual", "->>": "MinusDoubleArrow", "<->": "LessThanMinusArrow",
    "##": "DoubleHash", "&&": "DoubleAnd", "||": "DoubleOr", "==": "DoubleEquals", "!=": "ExclamationEquals", "<=": "LessThanEquals", ">=": "GreaterThanEquals",
    "<<": "LeftShift", ">>": "RightShift", "**": "DoubleStar", "++": "DoublePlus", "--": "DoubleMinus", "+=": "PlusEqual", "-=": "MinusEqual", "*=": "StarEqual",
    "/=": "SlashEqual", "%=": "PercentEqual", "&=": "AndEqual", "|=": "OrEqual", "^=": "XorEqual", "~&": "TildeAnd", "~|": "TildeOr", "~^": "TildeXor", "^~": "XorTilde",
    "->": "MinusArrow", "::": "DoubleColon", "+:": "PlusColon", "-:": "MinusColon", "'{": "ApostropheOpenBrace", "=": "Equals", "<": "LessThan", ">": "GreaterThan",
    "+": "Plus", "-": "Minus", "*": "Star", "/": "Slash", "%": "Percent", "&": "And", "|": "Or", "^": "Xor", "~": "Tilde", "!": "Exclamation", "?": "Question",
    ":": "Colon", ";": "Semicolon", ",": "Comma", ".": "Dot", "(": "OpenParenthesis", ")": "CloseParenthesis", "[": "OpenBracket", "]": "CloseBracket",
    "{": "OpenBrace", "}": "CloseBrace", "@": "At", "#": "Hash", "$": "Dollar", "'": "Apostrophe",
}

_LEX = re.compile(
    r"""(?P<space>[ \t\r\f\v]+|\n)
      |(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
      |(?P<directive>`[A-Za-z_]\w*)
      |(?P<string>"(?:\\.|[^"\\\n])*"?)
      |(?P<escaped>\\[^\s]+)
      |(?P<ident>[A-Za-z_][\w$]*)
      |(?P<system>\$[A-Za-z_][\w$]*)
      |(?P<base>'[sS]?[bBoOdDhH](?=[ \t]*[0-9a-fA-FxXzZ?_]))
      |(?P<fill>'[01xXzZ](?![\w]))
      |(?P<real>\d[\d_]*(?:\.\d[\d_]*(?:[eE][+-]?\d+)?|[eE][+-]?\d+))
      |(?P<int>\d[\d_]*)
      |(?P<op>"""
    + "|".join(re.escape(o) for o in sorted(OPERATORS, key=len, reverse=True))
    + r""")
      |(?P<other>.)""",
    re.X | re.S,
)
_VALUE = re.compile(r"[ \t]*([0-9a-fA-FxXzZ?_]+)")
_REST = re.compile(r"(?:\\\n|[^\n])*")
_DEFINE = re.compile(r"[ \t]+([A-Za-z_]\w*)")
_WORD = re.compile(r"[ \t]*([A-Za-z_]\w*)")
_INCLUDE = re.compile(r"""[ \t]*(?:"([^"\n]+)"|<([^>\n]+)>)""")
_PIECE = re.compile(r"""(?P<string>"(?:\\.|[^"\\\n])*"?)|(?P<paste>``)|(?P<quote>`")|(?P<name>[A-Za-z_][\w$]*)|(?P<other>.)""", re.S)
_BLOCK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
#: Uses inside uses; one that is still deeper stays in the stream as a token of its own.
DEEPEST = 200


def _arguments(text: str, at: int) -> tuple[list[str], int] | None:
    """Texts between the commas of a bracketed list that begins at or after `at`, and where it ends."""
    n = len(text)
    while at < n and text[at] in " \t\r\n":
        at += 1
    if at >= n or text[at] != "(":
        return None
    out, depth, lo, at = [], 1, at + 1, at + 1
    while at < n:
        c = text[at]
        if c == '"':
            at += 1
            while at < n and text[at] not in '"\n':
                at += 2 if text[at] == "\\" else 1
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return [*out, text[lo:at].strip()], at + 1
        elif c == "," and depth == 1:
            out.append(text[lo:at].strip())
            lo = at + 1
        at += 1
    return None


class Macro(NamedTuple):
    body: str
    params: list[tuple[str, str | None]] | None = None  # names with their defaults; None without an argument list

    def expand(self, args: list[str] | None) -> str:
        """The body with arguments in place of parameters; missing ones are their defaults or empty."""
        given = {}
        for i, (name, default) in enumerate(self.params or ()):
            value = args[i] if args and i < len(args) else ""
            given[name] = value or default or ""
        swap = {"paste": lambda m: "", "quote": lambda m: '"', "name": lambda m: given.get(m[0], m[0])}
        return "".join(swap.get(m.lastgroup, lambda m: m[0])(m) for m in _PIECE.finditer(self.body))


def beside(folder: str, name: str) -> str:
    """Path of a name in a folder, which may have a scheme."""
    head = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]+:/(?:/[^/]*)?)?", folder)[0]
    return head + posixpath.normpath(posixpath.join(folder[len(head) :], name))


class Source:
    """What a text sees besides itself: macros, the files it may include and what is open just now."""

    def __init__(self, files: dict[str, str] | None = None, path: str = "", folders: tuple[str, ...] = ()):
        self.macros: dict[str, Macro] = {}
        self.files, self.path, self.folders = files or {}, path, folders
        self.open: list[str] = []  # macros and files that are being read

    def find(self, name: str, path: str) -> str | None:
        """The included file: beside the including one, else in the folders in order."""
        return next((x for f in (posixpath.dirname(path), *self.folders) if (x := beside(f, name)) in self.files), None)


def lex(text: str, source: Source | None = None, place: tuple[int, int] | None = None, path: str | None = None) -> list[Token]:
    """Tokens of a text, without the end mark; `place` overrides positions inside a macro or an included file."""
    out: list[Token] = []
    source = Source() if source is None else source
    macros, path = source.macros, source.path if path is None else path
    line, bol, at, n = 1, 0, 0, len(text)
    active: list[list[bool]] = []  # per open conditional: [live now, some branch taken, outer live]

    def emit(kind: str, value: str, start: int):
        if place:
            out.append(Token(kind, value, *place, place[1] + len(value)))
        else:
            col = start - bol + 1
            out.append(Token(kind, value, line, col, col + len(value), start, start + len(value)))

    def read(what: str, inner: str, inner_path: str, start: int):
        """Tokens of a macro or file at the place of use; one inside itself is empty."""
        if what in source.open:
            return
        source.open.append(what)
        out.extend(lex(inner, source, place or (line, start - bol + 1), inner_path))
        source.open.pop()

    while at < n:
        m = _LEX.match(text, at)
        kind, value, start = m.lastgroup, m[0], at
        at = m.end()
        live = not active or active[-1][0]
        if kind == "directive":
            name = value[1:]
            if name in ("ifdef", "ifndef", "elsif"):
                w = _WORD.match(text, at)
                cond = bool(w and w[1] in macros) != (name == "ifndef")
                at = w.end() if w else at
                if name != "elsif":
                    active.append([live and cond, cond, live])
                elif active:
                    active[-1][0] = active[-1][2] and not active[-1][1] and cond
                    active[-1][1] |= cond
            elif name == "else":
                if active:
                    active[-1][0] = active[-1][2] and not active[-1][1]
                    active[-1][1] = True
            elif name == "endif":
                if active:
                    active.pop()
            elif name == "define":
                d = _DEFINE.match(text, at)
                named = _arguments(text, d.end()) if d and text[d.end() : d.end() + 1] == "(" else None
                rest = _REST.match(text, named[1] if named else d.end() if d else at)
                if d and live:
                    params = [(p.strip(), v.strip() if eq else None) for p, eq, v in (x.partition("=") for x in named[0])] if named else None
                    macros[d[1]] = Macro(_BLOCK.sub(" ", rest[0].replace("\\\n", " ")).strip(), params)
                line += text.count("\n", at, rest.end())
                bol = text.rfind("\n", 0, rest.end()) + 1
                at = rest.end()
            elif name == "undef":
                w = _WORD.match(text, at)
                if w:
                    at = w.end()
                    if live:
                        macros.pop(w[1], None)
            elif name in macros:
                got = _arguments(text, at) if macros[name].params is not None else None
                if live and len(source.open) < DEEPEST:
                    read(name, macros[name].expand(got and got[0]), path, start)
                elif live:
                    emit("MacroUsage", value, start)
                if got:
                    breaks = text.count("\n", at, got[1])
                    if breaks:
                        line += breaks
                        bol = text.rfind("\n", 0, got[1]) + 1
                    at = got[1]
            elif name == "include":
                w = _INCLUDE.match(text, at)
                found = source.find(w[1] or w[2], path) if w and live else None
                if found and len(source.open) < DEEPEST:
                    read(f"file {found}", source.files[found], found, start)
                at = _REST.match(text, at).end()
                line += text.count("\n", start, at)
            elif name in ("timescale", "default_nettype", "line", "pragma", "resetall", "celldefine", "endcelldefine", "begin_keywords", "end_keywords", "nounconnected_drive", "unconnected_drive", "undefineall"):
                at = _REST.match(text, at).end()
                line += text.count("\n", start, at)
            elif live:
                emit("MacroUsage", value, start)
            continue
        if live and kind not in ("space", "comment"):
            if kind == "ident":
                emit(KEYWORDS.get(value, "Identifier"), value, start)
            elif kind == "escaped":
                emit("Identifier", value[1:], start)
            elif kind == "op":
                emit(OPERATORS[value], value, start)
            elif kind == "base":
                emit("IntegerBase", value, start)
                v = _VALUE.match(text, at)
                emit("IntegerLiteral", v[1], v.start(1))
                at = v.end()
            else:
                emit({"string": "StringLiteral", "system": "SystemIdentifier", "fill": "UnbasedUnsizedLiteral", "real": "RealLiteral", "int": "IntegerLiteral", "other": "Unknown"}[kind], value, start)
        breaks = value.count("\n")
        if breaks:
            line += breaks
            bol = start + value.rfind("\n") + 1
    return out
