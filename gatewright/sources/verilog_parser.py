"""Recursive-descent parser: tokens to a syntax tree of plain nodes.

Covers modules, interfaces, packages and programs with their ports, parameters,
declarations, processes, statements, expressions, instances and generate constructs.  What
it does not know becomes an `Opaque` node that keeps its tokens; no input fails.
"""

from __future__ import annotations

from .verilog_lexer import KEYWORDS, OPERATORS, Source, Token, lex


class Node:
    __slots__ = ("children", "cls", "kind", "role")

    def __init__(self, kind: str, children: list, cls: str | None = None, role: str = ""):
        self.kind, self.cls, self.role = kind, cls or kind, role
        self.children = [c for c in children if c is not None]


class Leaf:
    __slots__ = ("role", "token")

    def __init__(self, token: Token, role: str = ""):
        self.token, self.role = token, role


# Kinds of assignment and other operators.
ASSIGN = {"Equals": "AssignmentExpression", "PlusEqual": "AddAssignmentExpression", "MinusEqual": "SubtractAssignmentExpression", "StarEqual": "MultiplyAssignmentExpression", "SlashEqual": "DivideAssignmentExpression", "PercentEqual": "ModAssignmentExpression", "AndEqual": "AndAssignmentExpression", "OrEqual": "OrAssignmentExpression", "XorEqual": "XorAssignmentExpression", "LeftShiftEqual": "LogicalLeftShiftAssignmentExpression", "RightShiftEqual": "LogicalRightShiftAssignmentExpression", "TripleLeftShiftEqual": "ArithmeticLeftShiftAssignmentExpression", "TripleRightShiftEqual": "ArithmeticRightShiftAssignmentExpression"}
ASSIGNMENT_KINDS = {*ASSIGN.values(), "NonblockingAssignmentExpression"}
COMPOUND_KINDS = ASSIGNMENT_KINDS - {"AssignmentExpression", "NonblockingAssignmentExpression"}
BINARY = {"DoubleOr": 1, "DoubleAnd": 2, "Or": 3, "Xor": 4, "TildeXor": 4, "XorTilde": 4, "And": 5, "DoubleEquals": 6, "ExclamationEquals": 6, "TripleEquals": 6, "ExclamationDoubleEquals": 6, "DoubleEqualsQuestion": 6, "ExclamationEqualsQuestion": 6, "LessThan": 7, "GreaterThan": 7, "LessThanEquals": 7, "GreaterThanEquals": 7, "InsideKeyword": 7, "LeftShift": 8, "RightShift": 8, "TripleLeftShift": 8, "TripleRightShift": 8, "Plus": 9, "Minus": 9, "Star": 10, "Slash": 10, "Percent": 10, "DoubleStar": 11}
UNARY = {"Plus", "Minus", "Exclamation", "Tilde", "And", "Or", "Xor", "TildeAnd", "TildeOr", "TildeXor", "XorTilde"}
NET = {f"{x}Keyword" for x in ("Wire", "Tri", "Tri0", "Tri1", "TriAnd", "TriOr", "UWire", "WAnd", "WOr", "Supply0", "Supply1")}
INTEGER_TYPES = {f"{x}Keyword": f"{x}Type" for x in ("Logic", "Reg", "Bit", "Byte", "ShortInt", "Int", "LongInt", "Integer", "Time")}
KEYWORD_TYPES = {f"{x}Keyword": f"{x}Type" for x in ("Real", "ShortReal", "RealTime", "String", "Event", "Void")}
DIRECTIONS = {"InputKeyword", "OutputKeyword", "InOutKeyword", "RefKeyword"}
DECLARATIONS = {"ModuleKeyword": ("ModuleDeclaration", "ModuleHeader", "EndModuleKeyword"), "InterfaceKeyword": ("InterfaceDeclaration", "InterfaceHeader", "EndInterfaceKeyword"), "PackageKeyword": ("PackageDeclaration", "PackageHeader", "EndPackageKeyword"), "ProgramKeyword": ("ProgramDeclaration", "ProgramHeader", "EndProgramKeyword")}
PROCESSES = {"AlwaysKeyword": "AlwaysBlock", "AlwaysCombKeyword": "AlwaysCombBlock", "AlwaysFFKeyword": "AlwaysFFBlock", "AlwaysLatchKeyword": "AlwaysLatchBlock", "InitialKeyword": "InitialBlock", "FinalKeyword": "FinalBlock"}
GATES = {"and", "nand", "nor", "xor", "xnor", "buf", "not", "bufif0", "bufif1", "notif0", "notif1", "nmos", "pmos", "cmos", "tran", "pullup", "pulldown"}
CLOSERS = {x[2] for x in DECLARATIONS.values()} | {"EndKeyword", "EndCaseKeyword", "EndGenerateKeyword", "EndFunctionKeyword", "EndTaskKeyword", "JoinKeyword", "JoinAnyKeyword", "JoinNoneKeyword"}
_EOF = "EndOfFile"
_SPELLING = {v: k for k, v in (KEYWORDS | OPERATORS).items()}


class Parser:
    def __init__(self, text: str, source: Source | None = None):
        self.toks = lex(text, source)
        lines = text.split("\n")
        self.eof = Token(_EOF, "", len(lines), len(lines[-1]) + 1, len(lines[-1]) + 1)
        self.i = 0

    # -- tokens
    @property
    def kind(self) -> str:
        return self.toks[self.i].kind if self.i < len(self.toks) else _EOF

    def ahead(self, k: int = 1) -> str:
        return self.toks[self.i + k].kind if self.i + k < len(self.toks) else _EOF

    def cur(self) -> Token:
        return self.toks[self.i] if self.i < len(self.toks) else self.eof

    def take(self, role: str = "") -> Leaf:
        t = self.cur()
        if self.i < len(self.toks):
            self.i += 1
        return Leaf(t, role)

    def maybe(self, *kinds: str, role: str = "") -> Leaf | None:
        return self.take(role) if self.kind in kinds else None

    def expect(self, kind: str, role: str = "") -> Leaf:
        """The token, or a missing one behind the last token read."""
        if self.kind == kind:
            return self.take(role)
        last = self.toks[self.i - 1] if self.i else self.cur()
        return Leaf(Token(kind, _SPELLING.get(kind, ""), last.line, last.end_col, last.end_col), role)

    def name(self, role: str = "name") -> Leaf:
        if self.kind == "Identifier":
            return self.take(role)
        t = self.cur()
        return Leaf(Token("Identifier", "", t.line, t.col, t.col), role)

    @staticmethod
    def empty(kind: str = "SyntaxList") -> Node:
        return Node(kind, [])

    def separated(self, item, stop: str | None = None, role: str = "") -> Node:
        out: list = []
        if self.kind != stop:
            while True:
                before = self.i
                out.append(item())
                comma = self.maybe("Comma")
                if not comma or self.i == before:
                    break
                out.append(comma)
        return Node("SeparatedList", out, role=role)

    def opaque(self) -> Node:
        """Tokens up to a semicolon outside brackets and blocks, or up to a closer."""
        out, depth = [], 0
        while self.kind != _EOF:
            k = self.kind
            if depth == 0 and (k in CLOSERS or k in DECLARATIONS):
                break
            out.append(self.take())
            if k in ("OpenParenthesis", "OpenBracket", "OpenBrace", "ApostropheOpenBrace", "BeginKeyword"):
                depth += 1
            elif k in ("CloseParenthesis", "CloseBracket", "CloseBrace", "EndKeyword"):
                depth -= 1
            elif k == "Semicolon" and depth <= 0:
                break
        if not out:
            out.append(self.take())
        return Node("Opaque", out)

    def opaque_until(self, closer: str) -> Node:
        out = [self.take()]
        while self.kind not in (closer, _EOF):
            out.append(self.take())
        if self.kind == closer:
            out.append(self.take())
            if self.kind == "Colon" and self.ahead() == "Identifier":
                out += [self.take(), self.take()]
        return Node("Opaque", out)

    # -- expressions
    def expression(self, nonblocking: bool = False, low: int = 0) -> Node:
        left = self.binary(low, nonblocking)
        if low == 0:
            if self.kind == "Question":
                predicate = Node("ConditionalPredicate", [Node("SeparatedList", [Node("ConditionalPattern", [left])])])
                left = Node("ConditionalExpression", [predicate, self.take(), self.empty(), self.expression(), self.expect("Colon"), self.expression()])
            kind = ASSIGN.get(self.kind) or ("NonblockingAssignmentExpression" if nonblocking and self.kind == "LessThanEquals" else None)
            if kind:
                left.role = "left"
                op, attrs = self.take(), self.empty()
                if self.kind in ("Hash", "At", "RepeatKeyword"):
                    timing = self.timing()
                    right = Node("TimingControlExpression", [timing, self.expression()])
                else:
                    right = self.expression()
                right.role = "right"
                left = Node(kind, [left, op, attrs, right], "BinaryExpression")
        return left

    def binary(self, low: int, nonblocking: bool) -> Node:
        left = self.unary()
        while True:
            k = self.kind
            rank = BINARY.get(k)
            if rank is None or rank <= low or nonblocking and k == "LessThanEquals":
                return left
            op = self.take()
            if k == "InsideKeyword":
                ranges = [self.expect("OpenBrace"), self.separated(self.value_range, "CloseBrace"), self.expect("CloseBrace")]
                left = Node("InsideExpression", [left, op, Node("RangeList", ranges)])
                continue
            left.role = "left"
            right = self.binary(rank - (k == "DoubleStar"), False)
            right.role = "right"
            left = Node(f"{k}Expression", [left, op, self.empty(), right], "BinaryExpression")

    def value_range(self) -> Node:
        if self.kind != "OpenBracket":
            return self.expression()
        return Node("ValueRangeExpression", [self.take(), self.expression(), self.expect("Colon"), self.expression(), self.expect("CloseBracket")])

    def unary(self) -> Node:
        k = self.kind
        if k in ("DoublePlus", "DoubleMinus"):
            op, attrs, operand = self.take(), self.empty(), self.unary()
            operand.role = "operand"
            return Node("UnaryPreincrementExpression" if k == "DoublePlus" else "UnaryPredecrementExpression", [op, attrs, operand], "PrefixUnaryExpression")
        if k in UNARY:
            op, attrs, operand = self.take(), self.empty(), self.unary()
            operand.role = "operand"
            return Node(f"Unary{k}Expression", [op, attrs, operand], "PrefixUnaryExpression")
        return self.postfix(self.primary())

    def postfix(self, left: Node) -> Node:
        while True:
            k = self.kind
            if k == "OpenParenthesis":
                left = Node("InvocationExpression", [left, self.empty(), self.arguments()])
            elif k == "Dot" or k == "DoubleColon":
                sep = self.take()
                left = Node("ScopedName", [left, sep, self.identifier()])
            elif k == "OpenBracket":
                left = Node("ElementSelectExpression", [left, self.select()])
            elif k in ("DoublePlus", "DoubleMinus"):
                left.role = "operand"
                left = Node("PostincrementExpression" if k == "DoublePlus" else "PostdecrementExpression", [left, self.empty(), self.take()], "PostfixUnaryExpression")
            elif k == "Apostrophe" and self.ahead() == "OpenParenthesis":
                left = Node("CastExpression", [left, self.take(), self.parenthesized()])
            else:
                return left

    def arguments(self) -> Node:
        return Node("ArgumentList", [self.take(), self.separated(self.argument, "CloseParenthesis"), self.expect("CloseParenthesis")])

    def argument(self) -> Node:
        if self.kind == "Dot":
            dot, name, lp = self.take(), self.name(), self.expect("OpenParenthesis")
            return Node("NamedArgument", [dot, name, lp, None if self.kind == "CloseParenthesis" else self.expression(), self.expect("CloseParenthesis")])
        if self.kind in ("Comma", "CloseParenthesis"):
            return Node("EmptyArgument", [])
        return Node("OrderedArgument", [self.event_or_expression()])

    def parenthesized(self) -> Node:
        return Node("ParenthesizedExpression", [self.expect("OpenParenthesis"), self.expression(), self.expect("CloseParenthesis")])

    def select(self) -> Node:
        lb = self.take()
        if self.kind == "CloseBracket":
            return Node("ElementSelect", [lb, self.take()])
        low = self.expression()
        if self.kind in ("Colon", "PlusColon", "MinusColon"):
            kind = {"Colon": "SimpleRangeSelect", "PlusColon": "AscendingRangeSelect", "MinusColon": "DescendingRangeSelect"}[self.kind]
            body = Node(kind, [low, self.take(), self.expression()], "RangeSelect")
        else:
            body = Node("BitSelect", [low])
        return Node("ElementSelect", [lb, body, self.expect("CloseBracket")])

    def identifier(self) -> Node:
        ident = self.name("identifier")
        if self.kind == "OpenBracket" and ident.token.text:
            picks = []
            while self.kind == "OpenBracket":
                picks.append(self.select())
            return Node("IdentifierSelectName", [ident, Node("SyntaxList", picks)])
        return Node("IdentifierName", [ident])

    def primary(self) -> Node:
        k = self.kind
        if k == "Identifier":
            return self.identifier()
        if k == "IntegerLiteral":
            first = self.take()
            if self.kind == "IntegerBase":
                return Node("IntegerVectorExpression", [first, self.take(), self.expect("IntegerLiteral")])
            return Node("IntegerLiteralExpression", [first], "LiteralExpression")
        if k == "IntegerBase":
            return Node("IntegerVectorExpression", [self.take(), self.expect("IntegerLiteral")])
        if k in ("StringLiteral", "RealLiteral", "UnbasedUnsizedLiteral", "MacroUsage", "Unknown"):
            return Node(f"{k}Expression", [self.take()], "LiteralExpression")
        if k == "SystemIdentifier":
            return Node("SystemName", [self.take()])
        if k == "OpenParenthesis":
            return self.parenthesized()
        if k == "OpenBrace":
            lb = self.take()
            if self.kind in ("LeftShift", "RightShift"):
                op = self.take()
                size = None if self.kind == "OpenBrace" else self.expression()
                return Node("StreamingConcatenationExpression", [lb, op, size, self.concatenation(self.expect("OpenBrace")), self.expect("CloseBrace")])
            return self.concatenation(lb)
        if k == "ApostropheOpenBrace":
            return Node("AssignmentPatternExpression", [self.take(), self.separated(self.pattern, "CloseBrace"), self.expect("CloseBrace")])
        if k in INTEGER_TYPES or k in KEYWORD_TYPES:
            return self.data_type()
        if k in ("Dollar", "DefaultKeyword"):
            return Node("WildcardLiteralExpression", [self.take()], "LiteralExpression")
        return Node("IdentifierName", [self.name("identifier")])

    def concatenation(self, lb: Leaf) -> Node:
        if self.kind == "CloseBrace":
            return Node("EmptyQueueExpression", [lb, self.take()])
        first = self.expression()
        if self.kind == "OpenBrace":
            inner = self.concatenation(self.take())
            return Node("MultipleConcatenationExpression", [lb, first, inner, self.expect("CloseBrace")])
        items: list = [first]
        while self.kind == "Comma":
            items += [self.take(), self.expression()]
        return Node("ConcatenationExpression", [lb, Node("SeparatedList", items), self.expect("CloseBrace")])

    def pattern(self) -> Node:
        value = self.expression()
        if self.kind == "Colon":
            return Node("AssignmentPatternItem", [value, self.take(), self.expression()])
        return value

    # -- events and delays
    def timing(self) -> Node:
        if self.kind == "Hash":
            h = self.take()
            value = self.parenthesized_list() if self.kind == "OpenParenthesis" else self.primary()
            return Node("DelayControl", [h, value])
        if self.kind == "RepeatKeyword":
            return Node("RepeatedEventControl", [self.take(), self.parenthesized(), self.timing()])
        at = self.take()
        if self.kind == "Star":
            return Node("ImplicitEventControl", [at, self.take()])
        if self.kind == "OpenParenthesis":
            if self.ahead() == "Star" and self.ahead(2) == "CloseParenthesis":
                return Node("ImplicitEventControl", [at, self.take(), self.take(), self.take()])
            lp = self.take()
            inner = Node("ParenthesizedEventExpression", [lp, self.event(), self.expect("CloseParenthesis")])
            return Node("EventControlWithExpression", [at, inner])
        return Node("EventControl", [at, self.postfix_name()])

    def parenthesized_list(self) -> Node:
        return Node("Delay3", [self.take(), self.separated(self.expression), self.expect("CloseParenthesis")])

    def postfix_name(self) -> Node:
        return self.postfix(self.identifier())

    def event(self) -> Node:
        left = self.event_term()
        while self.kind in ("OrKeyword", "Comma"):
            left = Node("BinaryEventExpression", [left, self.take(), self.event_term()])
        return left

    def event_term(self) -> Node:
        if self.kind == "OpenParenthesis":
            return Node("ParenthesizedEventExpression", [self.take(), self.event(), self.expect("CloseParenthesis")])
        return self.signal_event()

    def signal_event(self) -> Node:
        edge = self.maybe("PosEdgeKeyword", "NegEdgeKeyword", "EdgeKeyword", role="edge")
        value = self.expression()
        iff = Node("IffEventClause", [self.take(), self.expression()]) if self.kind == "IffKeyword" else None
        return Node("SignalEventExpression", [edge, value, iff])

    def event_or_expression(self) -> Node:
        return self.signal_event() if self.kind in ("PosEdgeKeyword", "NegEdgeKeyword", "EdgeKeyword") else self.expression()

    # -- types and declarators
    def dimensions(self) -> Node:
        out = []
        while self.kind == "OpenBracket":
            lb = self.take()
            body = None
            if self.kind == "Star":
                body = Node("WildcardDimensionSpecifier", [self.take()])
            elif self.kind != "CloseBracket":
                low = self.data_type() if self.kind in INTEGER_TYPES or self.kind in KEYWORD_TYPES else self.expression()
                if self.kind in ("Colon", "PlusColon", "MinusColon"):
                    low = Node("SimpleRangeSelect", [low, self.take(), self.expression()], "RangeSelect")
                else:
                    low = Node("BitSelect", [low])
                body = Node("RangeDimensionSpecifier", [low])
            out.append(Node("VariableDimension", [lb, body, self.expect("CloseBracket")]))
        return Node("SyntaxList", out)

    def signing(self) -> Leaf | None:
        return self.maybe("SignedKeyword", "UnsignedKeyword")

    def data_type(self) -> Node:
        k = self.kind
        if k in INTEGER_TYPES:
            return Node(INTEGER_TYPES[k], [self.take(), self.signing(), self.dimensions()], "IntegerType")
        if k in KEYWORD_TYPES:
            return Node(KEYWORD_TYPES[k], [self.take()], "KeywordType")
        if k in ("StructKeyword", "UnionKeyword"):
            head = [self.take(), self.maybe("PackedKeyword"), self.signing(), self.expect("OpenBrace")]
            members = []
            while self.kind not in ("CloseBrace", _EOF) and self.kind not in CLOSERS:
                before = self.i
                members.append(Node("StructUnionMember", [self.empty(), self.data_type(), self.separated(self.declarator), self.expect("Semicolon")]))
                if self.i == before:
                    members.append(self.opaque())
            return Node("StructType" if k == "StructKeyword" else "UnionType", [*head, Node("SyntaxList", members), self.expect("CloseBrace"), self.dimensions()], "StructUnionType")
        if k == "EnumKeyword":
            word = self.take()
            base = None if self.kind == "OpenBrace" else self.data_type()
            return Node("EnumType", [word, base, self.expect("OpenBrace"), self.separated(self.declarator, "CloseBrace"), self.expect("CloseBrace"), self.dimensions()])
        if k == "Identifier":
            return Node("NamedType", [self.scoped_type()])
        return self.implicit_type()

    def scoped_type(self) -> Node:
        left = self.type_name()
        while self.kind in ("DoubleColon", "Dot"):
            left = Node("ScopedName", [left, self.take(), self.type_name()])
        return left

    def type_name(self) -> Node:
        return self.identifier() if self.kind == "Identifier" and self.ahead() == "OpenBracket" else Node("IdentifierName", [self.name("identifier")])

    def implicit_type(self) -> Node:
        return Node("ImplicitType", [self.signing(), self.dimensions()])

    def declarator(self) -> Node:
        name, dims = self.name(), self.dimensions()
        init = Node("EqualsValueClause", [self.take(), self.expression()], role="initializer") if self.kind == "Equals" else None
        return Node("Declarator", [name, dims, init])

    def starts_named_type(self) -> bool:
        """Identifier (:: identifier)* [dims] identifier."""
        j = self.i
        kind = lambda x: self.toks[x].kind if x < len(self.toks) else _EOF
        if kind(j) != "Identifier":
            return False
        j += 1
        while kind(j) in ("DoubleColon", "Dot") and kind(j + 1) == "Identifier":
            j += 2
        while kind(j) == "OpenBracket":
            depth = 0
            while j < len(self.toks):
                depth += (kind(j) == "OpenBracket") - (kind(j) == "CloseBracket")
                j += 1
                if not depth:
                    break
        return kind(j) == "Identifier"

    # -- design elements
    def compilation_unit(self) -> Node:
        members = []
        while self.kind != _EOF:
            members.append(self.member())
        return Node("CompilationUnit", [Node("SyntaxList", members, role="members"), Leaf(self.eof)])

    def design_element(self) -> Node:
        kind, header, closer = DECLARATIONS[self.kind]
        head: list = [self.take(), self.maybe("AutomaticKeyword", "StaticKeyword"), self.name()]
        imports = []
        while self.kind == "ImportKeyword":
            imports.append(self.opaque())
        head.append(Node("SyntaxList", imports))
        if self.kind == "Hash":
            head.append(Node("ParameterPortList", [self.take(), self.expect("OpenParenthesis"), self.parameter_ports(), self.expect("CloseParenthesis")]))
        if self.kind == "OpenParenthesis":
            head.append(self.port_list())
        head.append(self.expect("Semicolon"))
        members = []
        while self.kind not in (closer, _EOF):
            if self.kind in CLOSERS and self.kind not in ("EndKeyword",):
                break
            members.append(self.member())
        end = self.expect(closer)
        label = Node("NamedBlockClause", [self.take(), self.name()]) if self.kind == "Colon" else None
        return Node(kind, [self.empty(), Node(header, head, "ModuleHeader", role="header"), Node("SyntaxList", members, role="members"), end, label], "ModuleDeclaration")

    def parameter_ports(self) -> Node:
        out: list = []
        while self.kind not in ("CloseParenthesis", _EOF):
            before = self.i
            word = self.maybe("ParameterKeyword", "LocalParamKeyword")
            kind = self.data_type() if self.kind != "Identifier" or self.starts_named_type() else self.implicit_type()
            out.append(Node("ParameterDeclaration", [word, kind, Node("SeparatedList", [self.declarator()])]))
            comma = self.maybe("Comma")
            if comma:
                out.append(comma)
            if self.i == before:
                out.append(self.take())
        return Node("SeparatedList", out)

    def port_list(self) -> Node:
        ansi = self.ahead() in DIRECTIONS | NET | INTEGER_TYPES.keys() | KEYWORD_TYPES.keys() | {"VarKeyword", "StructKeyword", "EnumKeyword", "InterfaceKeyword"} or self.ahead() == "Identifier" and self.ahead(2) in ("Identifier", "Dot")
        lp = self.take()
        if self.kind == "CloseParenthesis":
            return Node("AnsiPortList", [lp, self.empty("SeparatedList"), self.take()])
        if ansi:
            return Node("AnsiPortList", [lp, self.separated(self.ansi_port), self.expect("CloseParenthesis")])
        return Node("NonAnsiPortList", [lp, self.separated(self.plain_port), self.expect("CloseParenthesis")])

    def port_header(self) -> Node:
        direction = self.maybe(*DIRECTIONS, role="direction")
        if self.kind in NET:
            net = self.take()
            kind = self.data_type() if self.kind in INTEGER_TYPES or self.starts_named_type() else self.implicit_type()
            return Node("NetPortHeader", [direction, net, kind], role="header")
        var = self.maybe("VarKeyword")
        kind = self.implicit_type() if self.kind == "Identifier" and not self.starts_named_type() else self.data_type()
        return Node("VariablePortHeader", [direction, var, kind], role="header")

    def ansi_port(self) -> Node:
        before = self.i
        if self.kind == "Dot":
            return Node("ExplicitAnsiPort", [self.empty(), self.take(), self.name(), self.expect("OpenParenthesis"), self.expression(), self.expect("CloseParenthesis")])
        attrs = self.empty()
        port = Node("ImplicitAnsiPort", [attrs, self.port_header(), self.declarator()])
        if self.i == before:
            port = Node("Opaque", [self.take()])
        return port

    def plain_port(self) -> Node:
        if self.kind == "Dot":
            return Node("ExplicitNonAnsiPort", [self.take(), self.name(), self.expect("OpenParenthesis"), None if self.kind == "CloseParenthesis" else self.plain_port(), self.expect("CloseParenthesis")])
        return Node("ImplicitNonAnsiPort", [Node("PortReference", [self.name(), self.select() if self.kind == "OpenBracket" else None])])

    def parameter(self) -> Node:
        word = self.take()
        kind = self.data_type() if self.kind != "Identifier" or self.starts_named_type() else self.implicit_type()
        inner = Node("ParameterDeclaration", [word, kind, self.separated(self.declarator)])
        return Node("ParameterDeclarationStatement", [self.empty(), inner, self.expect("Semicolon")])

    def data_declaration(self) -> Node:
        attrs, mods = self.empty(), []
        while self.kind in ("ConstKeyword", "VarKeyword", "StaticKeyword", "AutomaticKeyword"):
            mods.append(self.take())
        kind = self.implicit_type() if mods and self.kind == "Identifier" and not self.starts_named_type() else self.data_type()
        names = self.separated(self.declarator) if self.kind == "Identifier" else self.empty("SeparatedList")
        return Node("DataDeclaration", [attrs, Node("TokenList", mods), kind, names, self.expect("Semicolon")])

    def instantiation(self) -> Node:
        attrs, kind, params = self.empty(), self.take("type"), None
        if self.kind == "Hash":
            h = self.take()
            if self.kind == "OpenParenthesis":
                params = Node("ParameterValueAssignment", [h, self.take(), self.separated(self.connection, "CloseParenthesis"), self.expect("CloseParenthesis")])
            else:
                params = Node("ParameterValueAssignment", [h, self.primary()])
        return Node("HierarchyInstantiation", [attrs, kind, params, self.separated(self.instance, role="instances"), self.expect("Semicolon")])

    def instance(self) -> Node:
        decl = Node("InstanceName", [self.name(), self.dimensions()], role="decl") if self.kind == "Identifier" else None
        return Node("HierarchicalInstance", [decl, self.expect("OpenParenthesis"), self.separated(self.connection, "CloseParenthesis"), self.expect("CloseParenthesis")])

    def connection(self) -> Node:
        if self.kind == "Dot":
            dot = self.take()
            if self.kind == "Star":
                return Node("WildcardPortConnection", [self.empty(), dot, self.take()])
            name = self.name()
            if self.kind != "OpenParenthesis":
                return Node("NamedPortConnection", [self.empty(), dot, name])
            lp = self.take()
            value = None if self.kind == "CloseParenthesis" else self.expression()
            return Node("NamedPortConnection", [self.empty(), dot, name, lp, value, self.expect("CloseParenthesis")])
        if self.kind in ("Comma", "CloseParenthesis"):
            return Node("EmptyPortConnection", [self.empty()])
        return Node("OrderedPortConnection", [self.empty(), self.expression()])

    def member(self) -> Node:
        k = self.kind
        if k in DECLARATIONS:
            return self.design_element()
        if k in PROCESSES:
            word = self.take()
            body = self.statement()
            body.role = "statement"
            return Node(PROCESSES[k], [self.empty(), word, body], "ProceduralBlock")
        if k == "Identifier":
            return self.named_member()
        if k in INTEGER_TYPES or k in KEYWORD_TYPES or k in ("StructKeyword", "UnionKeyword", "EnumKeyword", "ConstKeyword", "VarKeyword"):
            return self.data_declaration()
        if k in NET:
            attrs, net = self.empty(), self.take()
            kind = self.data_type() if self.kind in INTEGER_TYPES or self.starts_named_type() else self.implicit_type()
            delay = self.timing() if self.kind == "Hash" else None
            return Node("NetDeclaration", [attrs, net, kind, delay, self.separated(self.declarator), self.expect("Semicolon")])
        if k in DIRECTIONS:
            return Node("PortDeclaration", [self.empty(), self.port_header(), self.separated(self.declarator), self.expect("Semicolon")])
        if k in ("ParameterKeyword", "LocalParamKeyword"):
            return self.parameter()
        if k == "GenVarKeyword":
            return Node("GenvarDeclaration", [self.empty(), self.take(), self.separated(lambda: Node("IdentifierName", [self.name("identifier")])), self.expect("Semicolon")])
        if k == "AssignKeyword":
            word = self.take()
            delay = self.timing() if self.kind == "Hash" else None
            return Node("ContinuousAssign", [self.empty(), word, delay, self.separated(self.expression), self.expect("Semicolon")])
        if k == "DefParamKeyword":
            return Node("DefParam", [self.empty(), self.take(), self.separated(self.defparam), self.expect("Semicolon")])
        if k == "TypedefKeyword":
            return Node("TypedefDeclaration", [self.empty(), self.take(), self.data_type(), self.name(), self.dimensions(), self.expect("Semicolon")])
        if k == "GenerateKeyword":
            word, members = self.take(), []
            while self.kind not in CLOSERS | {_EOF}:
                members.append(self.member())
            return Node("GenerateRegion", [self.empty(), word, Node("SyntaxList", members), self.expect("EndGenerateKeyword")])
        if k in ("CaseKeyword", "CaseXKeyword", "CaseZKeyword"):
            return self.case("CaseGenerate", self.generate_item, None)
        if k == "IfKeyword":
            head = [self.empty(), self.take(), self.expect("OpenParenthesis"), self.expression(), self.expect("CloseParenthesis"), self.generate_item()]
            other = Node("ElseClause", [self.take(), self.generate_item()], role="elseClause") if self.kind == "ElseKeyword" else None
            return Node("IfGenerate", [*head, other])
        if k == "ForKeyword":
            head: list = [self.empty(), self.take(), self.expect("OpenParenthesis"), self.maybe("GenVarKeyword"), self.name("identifier"), self.expect("Equals"), self.expression(), self.expect("Semicolon"), self.expression(), self.expect("Semicolon"), self.expression(), self.expect("CloseParenthesis")]
            return Node("LoopGenerate", [*head, self.generate_item()])
        if k == "BeginKeyword":
            return self.generate_block()
        if k in ("FunctionKeyword", "TaskKeyword"):
            return self.subroutine()
        if k == "Semicolon":
            return Node("EmptyMember", [self.empty(), self.empty("TokenList"), self.take()])
        if k == "SpecifyKeyword":
            return self.opaque_until("EndSpecifyKeyword")
        if k == "ClassKeyword":
            return self.opaque_until("EndClassKeyword")
        return self.opaque()

    def named_member(self) -> Node:
        nxt = self.ahead()
        if self.cur().text in GATES and nxt in ("Identifier", "OpenParenthesis", "Hash"):
            word = self.take()
            delay = self.timing() if self.kind == "Hash" else None
            return Node("PrimitiveInstantiation", [self.empty(), word, delay, self.separated(self.instance), self.expect("Semicolon")])
        if nxt == "Hash" or nxt == "OpenParenthesis" or nxt == "Identifier" and self.ahead(2) == "OpenParenthesis":
            return self.instantiation()
        if nxt == "Identifier" and self.ahead(2) == "OpenBracket":  # an array of instances, or a declaration with dimensions
            j, depth = self.i + 2, 0
            while j < len(self.toks):
                depth += (self.toks[j].kind == "OpenBracket") - (self.toks[j].kind == "CloseBracket")
                j += 1
                if not depth and (j >= len(self.toks) or self.toks[j].kind != "OpenBracket"):
                    break
            if j < len(self.toks) and self.toks[j].kind == "OpenParenthesis":
                return self.instantiation()
        if nxt == "Colon" and self.ahead(2) not in ("Colon",):  # a label
            return Node("LabeledMember", [self.take(), self.take(), self.member()])
        # a declaration of a named type; without a declarator it is one that has none
        return self.data_declaration()

    def defparam(self) -> Node:
        name = self.postfix_name()
        return Node("DefParamAssignment", [name, Node("EqualsValueClause", [self.expect("Equals"), self.expression()])])

    def generate_block(self) -> Node:
        head: list = [self.empty(), self.take()]
        if self.kind == "Colon":
            head.append(Node("NamedBlockClause", [self.take(), self.name()]))
        members = []
        while self.kind not in CLOSERS | {_EOF}:
            members.append(self.member())
        end = self.expect("EndKeyword")
        label = Node("NamedBlockClause", [self.take(), self.name()]) if self.kind == "Colon" else None
        return Node("GenerateBlock", [*head, Node("SyntaxList", members), end, label])

    def generate_item(self) -> Node:
        if self.kind in CLOSERS | {_EOF}:
            return Node("EmptyMember", [self.empty(), self.empty("TokenList"), self.expect("Semicolon")])
        return self.member()

    def case(self, kind: str, body, modifier) -> Node:
        head: list = [self.empty(), modifier, self.take("keyword"), self.expect("OpenParenthesis"), self.expression(), self.expect("CloseParenthesis"), self.maybe("InsideKeyword")]
        items = []
        while self.kind not in CLOSERS | {_EOF}:
            before = self.i
            if self.kind == "DefaultKeyword":
                items.append(Node("DefaultCaseItem", [self.take(), self.maybe("Colon"), body()]))
            else:
                items.append(Node("StandardCaseItem", [self.separated(self.case_label), self.expect("Colon"), body()]))
            if self.i == before:
                items.append(Node("Opaque", [self.take()]))
        return Node(kind, [*head, Node("SyntaxList", items, role="items"), self.expect("EndCaseKeyword", "endCase")])

    def case_label(self) -> Node:
        return self.value_range() if self.kind == "OpenBracket" else self.expression()

    def subroutine(self) -> Node:
        function = self.kind == "FunctionKeyword"
        word, life = self.take(), self.maybe("AutomaticKeyword", "StaticKeyword")
        kind = None
        if function:
            kind = self.implicit_type() if self.kind == "Identifier" and not self.starts_named_type() else self.data_type()
        head = [word, life, kind, Node("IdentifierName", [self.name("identifier")])]
        if self.kind == "OpenParenthesis":
            head.append(Node("FunctionPortList", [self.take(), self.separated(self.function_port, "CloseParenthesis"), self.expect("CloseParenthesis")]))
        proto = Node("FunctionPrototype", [*head, self.expect("Semicolon")])
        closer = "EndFunctionKeyword" if function else "EndTaskKeyword"
        items = []
        self.block_items(items)
        end = self.expect(closer)
        label = Node("NamedBlockClause", [self.take(), self.name()]) if self.kind == "Colon" else None
        return Node("FunctionDeclaration" if function else "TaskDeclaration", [self.empty(), proto, Node("SyntaxList", items), end, label], "FunctionDeclaration")

    def function_port(self) -> Node:
        before = self.i
        direction, var = self.maybe(*DIRECTIONS), self.maybe("VarKeyword")
        kind = self.implicit_type() if self.kind == "Identifier" and not self.starts_named_type() else self.data_type()
        port = Node("FunctionPort", [self.empty(), direction, var, kind, self.declarator()])
        return Node("Opaque", [self.take()]) if self.i == before else port

    # -- statements
    def block_items(self, items: list) -> None:
        """Items up to a closer or a design element; an item that takes no token is not tried again."""
        while self.kind not in CLOSERS and self.kind not in DECLARATIONS and self.kind != _EOF:
            before = self.i
            items.append(self.block_item())
            if self.i == before:
                items.append(Node("Opaque", [self.take()]))

    def block_item(self) -> Node:
        k = self.kind
        if k in DIRECTIONS:
            return Node("PortDeclaration", [self.empty(), self.port_header(), self.separated(self.declarator), self.expect("Semicolon")])
        if k in INTEGER_TYPES or k in KEYWORD_TYPES or k in ("StructKeyword", "UnionKeyword", "EnumKeyword", "ConstKeyword", "VarKeyword", "StaticKeyword", "AutomaticKeyword") or self.starts_named_type():
            return self.data_declaration()
        if k in ("ParameterKeyword", "LocalParamKeyword"):
            return self.parameter()
        if k == "TypedefKeyword":
            return self.member()
        return self.statement()

    def statement(self) -> Node:
        k = self.kind
        if k == "Identifier" and self.ahead() == "Colon":
            label = Node("NamedLabel", [self.take(), self.take()])
            inner = self.statement()
            inner.children.insert(0, label)
            return inner
        if k in ("BeginKeyword", "ForkKeyword"):
            head: list = [self.empty(), self.take()]
            if self.kind == "Colon":
                head.append(Node("NamedBlockClause", [self.take(), self.name()]))
            items = []
            self.block_items(items)
            if k == "BeginKeyword":
                end = self.expect("EndKeyword")
            else:
                end = self.take() if self.kind in ("JoinKeyword", "JoinAnyKeyword", "JoinNoneKeyword") else self.expect("JoinKeyword")
            label = Node("NamedBlockClause", [self.take(), self.name()]) if self.kind == "Colon" else None
            return Node("SequentialBlockStatement" if k == "BeginKeyword" else "ParallelBlockStatement", [*head, Node("SyntaxList", items, role="items"), end, label], "BlockStatement")
        modifier = self.maybe("UniqueKeyword", "PriorityKeyword", "Unique0Keyword")
        k = self.kind
        if k in ("CaseKeyword", "CaseXKeyword", "CaseZKeyword"):
            return self.case("CaseStatement", self.statement, modifier)
        if k == "IfKeyword":
            word, lp, cond, rp = self.take(), self.expect("OpenParenthesis"), self.expression(), self.expect("CloseParenthesis")
            predicate = Node("ConditionalPredicate", [Node("SeparatedList", [Node("ConditionalPattern", [cond])])])
            body = self.statement()
            body.role = "statement"
            other = None
            if self.kind == "ElseKeyword":
                other = Node("ElseClause", [self.take(), self.statement()], role="elseClause")
            return Node("ConditionalStatement", [self.empty(), modifier, word, lp, predicate, rp, body, other])
        if k in ("At", "Hash"):
            attrs, timing = self.empty(), self.timing()
            return Node("TimingControlStatement", [attrs, timing, self.statement()])
        if k == "ForKeyword":
            head = [self.empty(), self.take(), self.expect("OpenParenthesis"), self.separated(self.loop_start, "Semicolon"), self.expect("Semicolon"), None if self.kind == "Semicolon" else self.expression(), self.expect("Semicolon"), self.separated(self.expression, "CloseParenthesis"), self.expect("CloseParenthesis")]
            return Node("ForLoopStatement", [*head, self.statement()])
        if k in ("WhileKeyword", "RepeatKeyword"):
            return Node("LoopStatement", [self.empty(), self.take(), self.expect("OpenParenthesis"), self.expression(), self.expect("CloseParenthesis"), self.statement()])
        if k == "ForeverKeyword":
            return Node("ForeverStatement", [self.empty(), self.take(), self.statement()])
        if k == "ForeachKeyword":
            return Node("ForeachLoopStatement", [self.empty(), self.take(), self.expect("OpenParenthesis"), self.expression(), self.expect("CloseParenthesis"), self.statement()])
        if k == "DoKeyword":
            return Node("DoWhileStatement", [self.empty(), self.take(), self.statement(), self.expect("WhileKeyword"), self.expect("OpenParenthesis"), self.expression(), self.expect("CloseParenthesis"), self.expect("Semicolon")])
        if k == "WaitKeyword" and self.ahead() == "OpenParenthesis":
            return Node("WaitStatement", [self.empty(), self.take(), self.take(), self.expression(), self.expect("CloseParenthesis"), self.statement()])
        if k == "Semicolon":
            return Node("EmptyStatement", [self.empty(), self.take()])
        if k in ("AssignKeyword", "ForceKeyword"):
            return Node("ProceduralAssignStatement", [self.empty(), self.take(), self.expression(), self.expect("Semicolon")])
        if k in ("DeassignKeyword", "ReleaseKeyword"):
            return Node("ProceduralDeassignStatement", [self.empty(), self.take(), self.expression(), self.expect("Semicolon")])
        if k in ("MinusArrow", "MinusDoubleArrow"):
            return Node("BlockingEventTriggerStatement", [self.empty(), self.take(), self.postfix_name(), self.expect("Semicolon")])
        if k == "ReturnKeyword":
            return Node("ReturnStatement", [self.empty(), self.take(), None if self.kind == "Semicolon" else self.expression(), self.expect("Semicolon")])
        if k in ("BreakKeyword", "ContinueKeyword"):
            return Node("JumpStatement", [self.empty(), self.take(), self.expect("Semicolon")])
        if k == "DisableKeyword":
            return Node("DisableStatement", [self.empty(), self.take(), self.postfix_name(), self.expect("Semicolon")])
        if k in CLOSERS or k == _EOF or k in DECLARATIONS:
            return Node("EmptyStatement", [self.empty(), self.expect("Semicolon")])
        before, attrs = self.i, self.empty()
        value = self.expression(nonblocking=True)
        if self.i == before:
            return self.opaque()
        value.role = "expr"
        return Node("ExpressionStatement", [attrs, value, self.expect("Semicolon")])

    def loop_start(self) -> Node:
        if self.kind in INTEGER_TYPES or self.kind in ("VarKeyword", "GenVarKeyword") or self.starts_named_type():
            var = self.maybe("VarKeyword", "GenVarKeyword")
            return Node("ForVariableDeclaration", [var, self.data_type(), self.declarator()])
        return self.expression()


def parse(text: str, files: dict[str, str] | None = None, path: str = "", folders: tuple[str, ...] = ()) -> Node:
    """The syntax tree; a text nested too deeply for the parser becomes one opaque member.  `files` are those that may be included."""
    p = Parser(text, Source(files, path, folders))
    try:
        return p.compilation_unit()
    except RecursionError:
        p = Parser(text, Source(files, path, folders))
        return Node("CompilationUnit", [Node("SyntaxList", [Node("Opaque", [Leaf(t) for t in p.toks])], role="members"), Leaf(p.eof)])
