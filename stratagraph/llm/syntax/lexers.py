"""Token symbols of source text, per language.

``lex(language, text)`` gives rows (symbol, depth change, unit end). Names, numbers and literals are reduced to their
class; keywords and operators stand for themselves. A bracket changes the depth by +1 or -1. ``unit end`` marks the
symbols after which a group's next unit begins. What is no token at all (an unterminated literal, a stray character,
a bad indentation) becomes ``ERR``, which no grammar permits.
"""

from __future__ import annotations

import re

ERR = "ERR"
LANGUAGES = {"go": "go", "py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "mjs": "javascript", "java": "java", "rs": "rust", "c": "c", "h": "c"}

# Keywords and word-like symbols of the grammars (fixed values).
KEYWORDS = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null var record sealed permits yield non module open",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union macro_rules default auto",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local __attribute__ __asm__ asm __extension__ typeof __typeof__ __inline __inline__ __restrict __builtin_va_arg",
    "javascript": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield null true false enum await let static async get set of from as",
}
KEYWORDS["typescript"] = KEYWORDS["javascript"] + " type interface namespace module declare abstract readonly public private protected implements is keyof infer unique asserts satisfies override accessor global"
_WORDS = {k: frozenset(v.split()) for k, v in KEYWORDS.items()}

_NUM = r"(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)"
_DQ = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"'
_SQ = r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
_CCOM = r"(?P<com>//[^\n]*|/\*[\s\S]*?\*/)"
_WS = r"(?P<ws>[ \t\r\f\v\u00a0\ufeff]+)|(?P<nl>\n)"


def _ops(text: str) -> str:
    return "|".join(re.escape(x) for x in sorted(text.split(), key=len, reverse=True))


def _re(*parts: str) -> re.Pattern:
    return re.compile("|".join(parts))


_PATTERNS = {
    "go": _re(
        _WS,
        _CCOM,
        r"(?P<str>" + r'"(?:[^"\\\n]|\\[^\n])*"' + r"|`[^`]*`)",
        r"(?P<chr>'(?:[^'\\\n]|\\[^\n])[^'\n]{0,9}'|'\\''|'[^'\n\\]')",
        r"(?P<num>" + _NUM + r"i?(?![\w]))",
        r"(?P<id>[^\W\d]\w*)",
        r"(?P<op>" + _ops("<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ ~ ! < > = ( ) [ ] { } , ; . :") + ")",
    ),
    "java": _re(
        _WS,
        _CCOM,
        r'(?P<str>"""[ \t\f]*\n(?:[^\\"]|\\[\s\S]|"(?!""))*"""|' + r'"(?:[^"\\\n]|\\[^\n])*")',
        r"(?P<chr>'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[^\n]))')",
        r"(?P<num>" + _NUM + r"[lLfFdD]?(?![\w]))",
        r"(?P<id>[^\W\d][\w$]*|\$[\w$]*)",
        r"(?P<op>" + _ops("... -> :: ++ -- && || == != <= >= += -= *= /= &= |= ^= %= << <<= >>= >>>= + - * / & | ^ % ! ~ ? : = < > ( ) [ ] { } , ; . @") + ")",
    ),
    "rust": _re(
        _WS,
        r"(?P<com>//[^\n]*)|(?P<nest>/\*)",
        r'(?P<raw>b?r(?P<hash>#*)")',
        r"(?P<str>[bc]?" + r'"(?:[^"\\]|\\[\s\S])*")',
        r"(?P<chr>b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|[nrt0\\'\"]))')",
        r"(?P<life>'[^\W\d]\w*(?!'))",
        r"(?P<num>0[xX][0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0[bB][01_]+(?:[iu](?:8|16|32|64|128|size))?|0[oO][0-7_]+(?:[iu](?:8|16|32|64|128|size))?|[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?(?:[iu](?:8|16|32|64|128|size)|f32|f64)?)(?!\w)",
        r"(?P<id>r#[^\W\d]\w*|[^\W\d]\w*)",
        r"(?P<op>" + _ops("... ..= .. -> => :: && || == != <= >= += -= *= /= &= |= ^= %= << <<= >>= + - * / & | ^ % ! ? : = < > ( ) [ ] { } , ; . @ # $ ~") + ")",
    ),
    "c": _re(
        _WS + r"|(?P<cont>\\\r?\n)",
        _CCOM,
        r"(?P<str>(?:u8|[uUL])?" + r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*")',
        r"(?P<chr>[uUL]?'(?:[^'\\\n]|\\[^\n])(?:[^'\\\n]|\\[^\n])*')",
        r"(?P<num>" + _NUM + r"[uUlLfF]*(?![\w]))",
        r"(?P<id>[^\W\d]\w*)",
        r"(?P<op>" + _ops("... -> ++ -- && || == != <= >= += -= *= /= &= |= ^= %= << >> <<= >>= ## + - * / & | ^ % ! ~ ? : = < > ( ) [ ] { } , ; . #") + ")",
    ),
    "javascript": _re(
        _WS.replace(r"\n", r"[\n\u2028\u2029]"),
        _CCOM,
        r"(?P<str>" + _DQ + "|" + _SQ + ")",
        r"(?P<tpl>`)",
        r"(?P<num>" + _NUM + r"n?(?![\w$]))",
        r"(?P<id>(?:[^\W\d]|[$_]|\\u\{[0-9a-fA-F]+\}|\\u[0-9a-fA-F]{4})(?:[\w$\u200c\u200d]|\\u\{[0-9a-fA-F]+\}|\\u[0-9a-fA-F]{4})*)",
        r"(?P<priv>\#(?:[^\W\d]|[$_])[\w$]*)",
        r"(?P<op>" + _ops("... => ++ -- && || ?? ?. === !== == != <= >= += -= *= /= &= |= ^= %= **= &&= ||= ??= <<= >>= >>>= << ** + - * / & | ^ % ! ~ ? : = < > ( ) [ ] { } , ; . @") + ")",
    ),
}
_PATTERNS["typescript"] = _PATTERNS["javascript"]
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_PY = _re(
    r"(?P<ws>[ \t\f]+)|(?P<nl>\r\n|\n|\r)|(?P<cont>\\(?:\r\n|\n|\r))",
    r"(?P<com>\#[^\r\n]*)",
    r"(?P<tri>(?:[rR]?[bB]|[bB][rR]|[rR]?[fF]|[fF][rR]|[uU]|[rR])?(?P<q>\"\"\"|'''))",
    r"(?P<str>(?:[rR]?[bB]|[bB][rR]|[uU]|[rR]|[rR]?[fF]|[fF][rR])?(?:" + r'"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"' + "|" + r"'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'" + "))",
    r"(?P<num>" + _NUM + r"[jJ]?(?!\w))",
    r"(?P<id>[^\W\d]\w*)",
    r"(?P<op>" + _ops("... := -> ** // << >> <= >= == != += -= *= /= //= %= @= &= |= ^= >>= <<= **= + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =") + ")",
)
_PAIR = {")": "(", "]": "[", "}": "{"}
_GO_ENDS = frozenset("id num str chr break continue fallthrough return ++ -- ) ] }".split())
_JS_ENDS = frozenset("id num str regex ) ] } break continue return this super null true false debugger ++ -- priv as of from get set async static let type is keyof yield await".split()) | (
    _WORDS["typescript"] - _WORDS["javascript"] - {"extends", "implements", "infer", "unique", "asserts", "satisfies"}
)
_JS_NO_START = frozenset(") ] , ; . ?. ? : = => == != === !== < > <= >= + - * / % & | ^ && || ?? ** << += -= *= /= %= &= |= ^= &&= ||= ??= **= <<= >>= ( [ in instanceof else catch finally of extends implements satisfies ...".split()) - {"-", "+"} | {"+", "-"}
_REGEX_AFTER_WORD = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())

Rows = list[tuple[str, int, bool]]


def symbols(language: str) -> frozenset[str]:
    """All symbols that the lexer of a language can give, but for ERR."""
    ops = {x.replace("\\", "") for x in re.findall(r"(?:\\.|[^|\\])+", (_PY if language == "python" else _PATTERNS[language]).pattern.rpartition("(?P<op>")[2][:-1])}
    return _WORDS[language] | frozenset(ops) | {"id", "num", "str", "chr", "nl", "life", "regex", "priv", "INDENT", "DEDENT"}


def lex(language: str, text: str) -> Rows:
    return _python(text) if language == "python" else _braces(language, text)


def _template(text: str, at: int) -> int:
    """The end of the template literal that begins at ``at``; -1 where it has none."""
    depth, i = [], at + 1
    while i < len(text):
        c = text[i]
        if c == "\\" and (not depth or text[i - 1] != "\\"):
            i += 2
            continue
        if not depth or depth[-1] == "`":
            if c == "`":
                if not depth:
                    return i + 1
                depth.pop()
            elif text.startswith("${", i):
                depth.append("{")
                i += 1
        elif c == "`":
            depth.append("`")
        elif c == "{":
            depth.append("{")
        elif c == "}":
            depth.pop()
        i += 1
    return -1


def _branch_end(text: str, at: int) -> int:
    """The end of the #endif that closes the branch going on at ``at``; -1 where there is none."""
    depth = 1
    for m in re.compile(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|endif)\b[^\n]*", re.M).finditer(text, at):
        depth += -1 if m.group(1) == "endif" else 1
        if not depth:
            return m.end()
    return -1


def _braces(language: str, text: str) -> Rows:
    words, match, js = _WORDS[language], _PATTERNS[language].match, language in ("javascript", "typescript")
    out: Rows = []
    stack: list[str] = []
    i, n, newline, prev, branches = 0, len(text), False, "", 0
    if text.startswith("\ufeff"):
        i = 1
    if text.startswith("#!", i) and (js or language == "rust") and not text.startswith("#![", i):
        i = (text.find("\n", i) + 1) or n

    def add(sym: str, d: int = 0, sep: bool = False) -> None:
        nonlocal prev
        out.append((sym, d, sep))
        prev = sym

    while i < n:
        if js and text[i] == "/" and text[i + 1 : i + 2] not in ("/", "*") and (
            prev in _REGEX_AFTER_WORD or not (prev in ("id", "num", "str", "regex", ")", "]", "priv", "this", "super", "null", "true", "false") or prev in words)
        ):
            m = _REGEX.match(text, i)
            kind = "regex"
        else:
            m = match(text, i)
            kind = m.lastgroup if m else ""
        if not m:
            return [*out, (ERR, 0, False)]
        value, start, i = m.group(), i, m.end()
        if kind == "ws" or kind == "cont":
            continue
        if kind == "nl" or kind == "com":
            if kind == "nl" or "\n" in value or language == "c":
                newline = newline or "\n" in value
                if language == "go" and prev in _GO_ENDS and "\n" in value:
                    add("nl", 0, True)
            continue
        if kind == "nest":
            depth, j = 1, i
            while depth:
                a, b = text.find("/*", j), text.find("*/", j)
                if b < 0:
                    return [*out, (ERR, 0, False)]
                depth, j = (depth + 1, a + 2) if 0 <= a < b else (depth - 1, b + 2)
            i = j
            continue
        if kind in ("raw", "hash"):
            end = '"' + m.group("hash")
            j = text.find(end, m.end("raw"))
            if j < 0:
                return [*out, (ERR, 0, False)]
            i, sym = j + len(end), "str"
        elif kind == "tpl":
            i = _template(text, start)
            if i < 0:
                return [*out, (ERR, 0, False)]
            sym = "str"
        elif kind == "id":
            sym = value if value in words else "id"
        elif kind == "op":
            sym = value
        else:
            sym = kind
        if language == "c" and sym == "#":
            # A directive is no token of the syntax; it goes on over escaped line ends.
            if prev == "" or newline or start == 0:
                d = re.compile(r"(?:[^\n\\/]|\\(?:\r?\n|[^\n])|/(?!\*)|/\*[\s\S]*?\*/)*").match(text, i)
                word, rest = re.match(r"[ \t]*(\w*)[ \t\r]*(.?)", d.group()).groups()
                i = d.end()
                branches += (word in ("if", "ifdef", "ifndef")) - (word == "endif")
                if branches < 0 or (not word and rest) or (not branches and word in ("elif", "else", "elifdef", "elifndef")):
                    return [*out, (ERR, 0, False)]
                if (word in ("if", "ifdef") and rest and re.match(r"[ \t]*(?:if[ \t]+0|ifdef[ \t]+__cplusplus)\b", d.group())) or word in ("else", "elif", "elifdef", "elifndef"):
                    # Of the branches only the first is read, and none that C never takes.
                    end = _branch_end(text, i)
                    if end < 0:
                        return [*out, (ERR, 0, False)]
                    i, branches = end, branches - 1
                    newline = True
                    continue
                if word not in ("include", "define", "undef", "if", "ifdef", "ifndef", "elif", "else", "endif", "line", "error", "pragma", "warning", "", "include_next", "ident", "elifdef", "elifndef"):
                    return [*out, (ERR, 0, False)]
                continue
            return [*out, (ERR, 0, False)]
        if js and newline and prev in _JS_ENDS and sym not in _JS_NO_START and (not stack or stack[-1] == "{") and not (sym in ("{", "while") and prev in (")", "}")) and sym != "}":
            add("nl", 0, True)
        newline = False
        if sym in ("(", "[", "{"):
            stack.append(sym)
            add(sym, 1)
        elif sym in _PAIR:
            if stack and stack[-1] == _PAIR[sym]:
                stack.pop()
            add(sym, -1)
        elif sym == ";":
            ends = (not stack or stack[-1] == "{") and language != "go"
            if ends and language != "rust":
                rest = re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*(else|while)\b").match(text, i)
                ends = rest is None
            add(sym, 0, ends)
        else:
            add(sym)
    if language == "go" and prev in _GO_ENDS:
        add("nl", 0, True)
    if branches:
        add(ERR)
    return out


def _python(text: str) -> Rows:
    out: list[list] = []
    stack: list[str] = []
    indents, blocks, waiting = [0], [], None
    alts = [(0, 0)]
    i, n, prev, decorator = (1 if text.startswith("\ufeff") else 0), len(text), "", False
    words = _WORDS["python"]

    def err() -> Rows:
        return [*map(tuple, out), (ERR, 0, False)]

    at_line = True
    while i < n:
        if at_line and not stack:
            j, col, alt = i, 0, 0
            while j < n and text[j] in " \t\f":
                col = 0 if text[j] == "\f" else (col // 8 + 1) * 8 if text[j] == "\t" else col + 1
                alt = 0 if text[j] == "\f" else alt + 1
                j += 1
            if j >= n or text[j] in "\r\n#" or (text[j] == "\\" and text[j + 1 : j + 2] in ("\n", "\r")):
                i = j
                at_line = j < n and text[j] != "\\"
                m = _PY.match(text, i) if i < n else None
                if m:
                    i = m.end()
                    at_line = m.lastgroup != "com" and at_line
                    if m.lastgroup == "com":
                        at_line = True
                        k = re.compile(r"\r\n|\n|\r").match(text, i)
                        i = k.end() if k else i
                continue
            i, at_line = j, False
            if prev == "nl" or not out:
                if col > indents[-1]:
                    if alt <= alts[-1][0] and len(indents) > 1:
                        return err()
                    if out and out[-1][0] == "nl":
                        out.pop()
                    blocks.append(len(out))
                    out.append(["INDENT", 1, False])
                    indents.append(col)
                    alts.append((alt, 0))
                else:
                    word = re.compile(r"(elif|else|except|finally)\b").match(text, j)
                    while col < indents[-1]:
                        indents.pop()
                        alts.pop()
                        out.append(["DEDENT", -1, False])
                        opened = blocks.pop()
                        waiting = opened
                        out[opened][2] = not (word and col == indents[-1])
                    if col != indents[-1]:
                        return err()
            prev = "line"
        m = _PY.match(text, i)
        if not m:
            return err()
        kind, value, i = m.lastgroup, m.group(), m.end()
        if kind in ("ws", "com", "cont"):
            if kind == "cont" and i >= n:
                return err()
            continue
        if kind == "nl":
            if not stack:
                out.append(["nl", 0, not decorator])  # a decorator and what it decorates are one statement
                prev, at_line = "nl", True
            continue
        if kind in ("tri", "q"):
            q = m.group("q")
            j = m.end()
            while True:
                j = text.find(q, j)
                if j < 0:
                    return err()
                k = j - 1
                while k >= m.end() and text[k] == "\\":
                    k -= 1
                if (j - k - 1) % 2 == 0:
                    break
                j += 1
            i, sym = j + 3, "str"
        elif kind == "id":
            sym = value if value in words else "id"
        elif kind == "op":
            sym = value
        else:
            sym = kind
        if prev == "line":
            decorator = sym == "@"
            if sym in ("elif", "else", "except", "finally") and out and out[-1][0] == "nl":
                out[-1][2] = False
        prev = sym
        if sym in ("(", "[", "{"):
            stack.append(sym)
            out.append([sym, 1, False])
        elif sym in _PAIR:
            if stack and stack[-1] == _PAIR[sym]:
                stack.pop()
            out.append([sym, -1, False])
        else:
            out.append([sym, 0, False])
    if prev not in ("nl", ""):
        out.append(["nl", 0, True])
    while len(indents) > 1:
        indents.pop()
        out.append(["DEDENT", -1, False])
        out[blocks.pop()][2] = True
    return [tuple(r) for r in out]
