"""Tokens and grammars of eight programming languages, as far as telling valid from invalid files needs them.

Names, types and imports are not resolved. Template strings and JSX elements are one token; of preprocessor branches the
first is read; words that are reserved only in some places are names everywhere else.
"""

from __future__ import annotations

import re
from functools import lru_cache

from graphloom.llm.chart import Grammar, SharedChart

#: Language of a file by the suffix of its path.
SUFFIXES = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "java": "java", "go": "go", "rs": "rust", "cs": "csharp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "h": "cpp", "c": "cpp",
}


def language_of(path: str | None) -> str | None:
    return SUFFIXES.get((path or "").rsplit(".", 1)[-1].lower())


# Reserved words by language: each is a token of its own.
_WORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with let async of static yield await from as get set",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true false try void volatile while",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while",
    "csharp": "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while",
    "cpp": "alignas auto bool break case catch char class const constexpr consteval const_cast continue decltype default delete do double dynamic_cast else enum explicit extern false final float for friend goto if inline int long mutable namespace new noexcept nullptr operator override private protected public reinterpret_cast return short signed sizeof static static_assert static_cast struct switch template this thread_local throw true try typedef typeid typename union unsigned using virtual void volatile wchar_t while",
}
_WORDS["typescript"] = _WORDS["javascript"] + " interface type enum namespace declare abstract readonly implements public private protected keyof infer is satisfies module"

# Words with a meaning of their own in some places only: tokens of their own that may stand wherever a name may.
_SOFT = {
    "python": "type match case", "java": "yield record sealed permits when non",
    "csharp": "global alias partial async required file record where get set init add remove yield await from select orderby group by into join equals on let ascending descending when and or not with",
}

# Operators: those only ever between operands are BOP, assigning ones ASG, all others tokens of their own.
_BINARY = {
    "python": "== != <= >= // / % | & ^ << >> < >", "javascript": "=== !== == != <= && || ?? / % ^ | << ** &", "java": "== != <= >= && || / % ^ | <<", "go": "== != <= >= && || / % | << >> &^", "rust": "== != <= / % ^ <<",
    "csharp": "== != <= && || ?? / % ^ | <<", "cpp": "== != <= || / % ^ | << <=>",
}
_BINARY["typescript"] = "=== !== == != <= && || ?? / % ^ << **"
_ASSIGNING = {
    "python": "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=", "javascript": "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=", "java": "+= -= *= /= %= <<= >>= >>>= &= |= ^=", "go": "+= -= *= /= %= <<= >>= &= |= ^= &^=",
    "rust": "+= -= *= /= %= <<= >>= &= |= ^=", "csharp": "+= -= *= /= %= <<= >>= &= |= ^= ??=", "cpp": "+= -= *= /= %= <<= >>= &= |= ^=",
}
_ASSIGNING["typescript"] = _ASSIGNING["javascript"]
_OTHER = {
    "python": "** -> := ... + - * ~ = @ . , : ; ( ) [ ] { }", "javascript": "=> ?. ... ++ -- + - * ! ~ < > = ? : . , ; ( ) [ ] { } # @", "java": "-> :: ... ++ -- + - * & ! ~ < > = ? : . , ; ( ) [ ] { } @",
    "go": ":= ... <- ++ -- + - * & ^ ! ~ < > = : . , ; ( ) [ ] { }", "rust": ":: -> => ..= ... .. && || + - * & | ! < > = ? : . , ; ( ) [ ] { } # @ $ ~", "csharp": "=> ?. :: .. ++ -- + - * & ! ~ < > = ? : . , ; ( ) [ ] { } #",
    "cpp": ":: ->* -> ... ++ -- && + - * & ! ~ < > = ? : . , ; ( ) [ ] { }",
}
_OTHER["typescript"] = _OTHER["javascript"] + " | &"

_NUMBER = r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_']*\d|\d)(?:\.(?!\.)(?:\d[\d_]*)?)?(?:[eE][+-]?\d[\d_]*)?|\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?)"
_SUFFIX = {"python": "[jJ]?", "javascript": "n?", "typescript": "n?", "java": "[lLfFdD]?", "go": "i?", "rust": r"(?:_?[iuf](?:8|16|32|64|128|size))?", "csharp": "(?:[uU]?[lL]?[uU]?|[fFdDmM])", "cpp": r"(?:[uU]?[lL]{0,2}[uU]?[zZ]?|[fF]|_\w+)"}
_DOUBLE = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"'
_SINGLE = r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
_CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,9})'"
_STRINGS = {
    "python": r'(?:[rRbBuUfFtT]{0,3})(?:"""(?:[^\\]|\\[\s\S])*?"""|' + r"'''(?:[^\\]|\\[\s\S])*?'''" + rf"|(?!\"\"\"|''')(?:{_DOUBLE}|{_SINGLE}))",
    "javascript": f"{_DOUBLE}|{_SINGLE}", "typescript": f"{_DOUBLE}|{_SINGLE}",
    "java": rf'"""[\s\S]*?"""|{_DOUBLE}|{_CHAR}', "go": rf"{_DOUBLE}|`[^`]*`|{_CHAR}",
    "rust": r'b?r(?P<h>#*)"[\s\S]*?"(?P=h)|[bc]?"(?:[^"\\]|\\[\s\S])*"|b?' + _CHAR,
    "csharp": rf'(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?"""[\s\S]*?"""|\$?{_DOUBLE}|{_CHAR}',
    "cpp": rf'(?:u8|[uUL])?R"(?P<d>[^()\\\s]{{0,16}})\([\s\S]*?\)(?P=d)"|(?:u8|[uUL])?(?:{_DOUBLE}|{_CHAR})',
}
_CONFLICT = r"(?m:^(?:<{7}|>{7}|\|{7}|={7})(?:[ \t][^\n]*)?\r?$)"


@lru_cache(maxsize=None)
def _lexer(language: str) -> tuple:
    operators = {**{x: "BOP" for x in _BINARY[language].split()}, **{x: "ASG" for x in _ASSIGNING[language].split()}, **{x: x for x in _OTHER[language].split()}}
    longest = "|".join(re.escape(x) for x in sorted(operators, key=len, reverse=True))
    comment = r"\#[^\n]*" if language == "python" else r"//[^\n]*|/\*[\s\S]*?\*/"
    broken = r"/\*" if language != "python" else r"(?!)"
    name = r"[^\W\d][\w]*" if language not in ("javascript", "typescript", "java") else r"[^\W\d][\w$]*|\$[\w$]*"
    if language == "csharp":
        name = r"@?[^\W\d]\w*"
    if language == "rust":
        name = r"'[^\W\d]\w*(?!')|(?:r\#)?[^\W\d]\w*"
    quote = {"python": r"[rRbBuUfF]{0,2}[\"']", "csharp": r"[@$]{0,2}\"|'"}.get(language, r"[\"'`]")
    pattern = re.compile(
        rf"(?P<blank>[ \t\f\r\v\xa0﻿]+)|(?P<conflict>{_CONFLICT})|(?P<nl>\n)|(?P<comment>{comment})|(?P<string>{_STRINGS[language]})|(?P<broken>{broken}|{quote if language != 'rust' else chr(34)})"
        rf"|(?P<number>{_NUMBER}{_SUFFIX[language]}(?!\w))|(?P<name>{name})|(?P<op>{longest})|(?P<bad>[\s\S])"
    )
    return pattern, operators, frozenset([*_WORDS[language].split(), *_SOFT.get(language, "").split()])


_VALUE_END = frozenset(["ID", "NUM", "STR", "TMPL", "RE", "JSX", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"])
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_NO_ASI_BEFORE = frozenset(". ?. , ; ) ] } = ? : BOP ASG => * + - & | < > ( [ in instanceof else catch finally while of as from TMPL".split())
_ASI_AFTER = _VALUE_END | {"return", "break", "continue", "debugger"}
_GO_END = frozenset(["ID", "NUM", "STR", ")", "]", "}", "return", "break", "continue", "fallthrough", "++", "--"])


def _template(text: str, at: int) -> int:
    """End of the template string that begins at ``at``, nested ones included; -1 if it has none."""
    i, n = at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and text[i + 1 : i + 2] == "{":
            depth, i = 1, i + 2
            while i < n and depth:
                c = text[i]
                if c == "`":
                    i = _template(text, i)
                    if i < 0:
                        return -1
                    continue
                if c in "\"'":
                    m = re.compile(_DOUBLE if c == '"' else _SINGLE).match(text, i)
                    i = m.end() if m else i + 1
                    continue
                depth += (c == "{") - (c == "}")
                i += 1
        else:
            i += 1
    return -1


_TAG_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_GAP = re.compile(r"(?:\s+|//[^\n]*|/\*[\s\S]*?\*/)*")


def _braces(text: str, at: int) -> int:
    """End of the ``{...}`` that begins at ``at``, with its strings, comments, templates and elements; -1 if it has none."""
    i, n, depth = at, len(text), 0
    while i < n:
        c = text[i]
        if c == "`":
            i = _template(text, i)
            if i < 0:
                return -1
            continue
        if c in "\"'":
            m = re.compile(_DOUBLE if c == '"' else _SINGLE).match(text, i)
            i = m.end() if m else i + 1
            continue
        if c == "/" and (m := re.compile(r"//[^\n]*|/\*[\s\S]*?\*/").match(text, i)):
            i = m.end()
            continue
        if c == "<" and text[i + 1 : i + 2].isalpha() | (text[i + 1 : i + 2] == ">") and re.search(r"[({\[,;?:&|=>]\s*$|\breturn\s*$", text[at:i]) and (e := _element(text, i)) > 0:
            i = e
            continue
        depth += (c == "{") - (c == "}")
        i += 1
        if not depth:
            return i
    return -1


def _element(text: str, at: int) -> int:
    """End of the JSX element or fragment that begins at ``at``, its tags paired; -1 if there is none."""
    m = _TAG_NAME.match(text, at + 1)
    name, i = (m.group(), m.end()) if m else ("", at + 1)
    while True:  # attributes
        i = _GAP.match(text, i).end()
        if text.startswith("/>", i) and name:
            return i + 2
        if text.startswith(">", i):
            i += 1
            break
        if text.startswith("{", i):
            i = _braces(text, i)
        elif name and (m := _TAG_NAME.match(text, i)):
            i = _GAP.match(text, m.end()).end()
            if text.startswith("=", i):
                i = _GAP.match(text, i + 1).end()
                if text.startswith("{", i):
                    i = _braces(text, i)
                elif text.startswith("<", i):
                    i = _element(text, i)
                else:
                    m = re.compile(r"\"[^\"]*\"|'[^']*'").match(text, i)
                    i = m.end() if m else -1
        else:
            return -1
        if i < 0:
            return -1
    while True:  # children
        i = min((x for x in (text.find("<", i), text.find("{", i)) if x >= 0), default=-1)
        if i < 0:
            return -1
        if text[i] == "{":
            i = _braces(text, i)
        elif text.startswith("</", i):
            i = _GAP.match(text, i + 2).end()
            if not text.startswith(name, i):
                return -1
            i = _GAP.match(text, i + len(name)).end()
            return i + 1 if text.startswith(">", i) else -1
        else:
            i = _element(text, i)
        if i < 0:
            return -1


_CONDITION = re.compile(r"[ \t]*#[ \t]*(if|ifdef|ifndef|elif|else|endif)\b[ \t]*(.*)")


def _one_branch(text: str) -> str:
    """C++ text in which of each group of preprocessor branches the first is kept, ``#if 0`` aside; lines are kept in number."""
    out, kept = [], [(True, True)]  # whether lines are kept, and whether some branch of the group was
    for line in text.split("\n"):
        m = _CONDITION.match(line)
        if not m:
            out.append(line if kept[-1][0] else "")
            continue
        word, never = m[1], m[2].split("//")[0].strip() in ("0", "false")
        if word.startswith("if"):
            kept.append((kept[-1][0] and not never, not never))
        elif word == "endif" or len(kept) == 1:
            kept = kept[:-1] if len(kept) > 1 else kept
        else:
            taken = kept[-1][1]
            kept[-1] = (kept[-2][0] and not taken and not never, taken or not never)
        out.append("")
    return "\n".join(out)


def tokenize(language: str, text: str, path: str | None = None) -> tuple[list[str], list[int]]:
    """Token classes of a text and the line of each; unknown and unterminated pieces are ERR, merge markers CONFLICT.

    JSX elements are one token each, read where ``path`` says that a script may hold them."""
    pattern, operators, words = _lexer(language)
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    if language == "cpp":
        text = _one_branch(text)
        text = re.sub(r"(?m)^[ \t]*#[ \t]*(?:include|define|undef|pragma|error|warning|line)?\b(?:\\\n|[^\n])*", "", text)
    if language == "csharp":
        text = re.sub(r"(?m)^[ \t]*#[ \t]*(?:region|endregion|if|else|elif|endif|pragma|nullable|define|undef|error|warning|line)\b[^\n]*", "", text)
    if language in ("javascript", "typescript") and text.startswith("#!"):
        text = "//" + text
    script = language in ("javascript", "typescript")
    elements = script and (path or "").lower().endswith(("x", ".js", ".mjs", ".cjs"))
    out: list[str] = []
    lines: list[int] = []
    line, at, n, depth, fresh = 1, 0, len(text), 0, False
    match = pattern.match
    indent = [(0, 0)]  # columns with tabs of 8 and of 1: both must agree
    if language == "python":
        blank_line = re.compile(r"[ \t\f]*(?:\#[^\n]*)?(?:\n|$)")
        column_of = re.compile(r"[ \t\f]*")
        begin = True
    while at < n:
        if language == "python" and begin and not depth:
            m = blank_line.match(text, at)
            if m and m.end() > at and (m.end() < n or text[at:].strip() == "" or text[at:].lstrip().startswith("#")):
                line += text.count("\n", at, m.end())
                at = m.end()
                continue
            m = column_of.match(text, at)
            column = len(m.group().expandtabs(8)), len(m.group())
            if column[0] > indent[-1][0] and column[1] > indent[-1][1]:
                indent.append(column)
                out.append("INDENT")
                lines.append(line)
            else:
                while column[0] < indent[-1][0]:
                    indent.pop()
                    out.append("DEDENT")
                    lines.append(line)
                if column != indent[-1]:
                    out.append("ERR")
                    lines.append(line)
                    indent.append(column)
            at = m.end()
            begin = False
            continue
        if text[at] == "`" and script:
            end = _template(text, at)
            kind = "TMPL" if end > 0 else "ERR"
            end = end if end > 0 else n
        elif text[at] == "<" and elements and (not out or out[-1] not in _VALUE_END or fresh) and (text[at + 1 : at + 2].isalpha() or text[at + 1 : at + 2] == ">") and (end := _element(text, at)) > 0:
            kind = "JSX"
        elif text[at] == "/" and script and (not out or out[-1] not in _VALUE_END) and (m := _REGEX.match(text, at)):
            kind, end = "RE", m.end()
        else:
            m = match(text, at)
            group, end = m.lastgroup, m.end()
            if group in ("h", "d"):
                group = "string"
            if group == "blank":
                at = end
                continue
            if group in ("nl", "comment"):
                count = text.count("\n", at, end)
                line += count
                at = end
                if group == "nl" or count:
                    fresh = True
                    if language == "go" and out and out[-1] in _GO_END:
                        out.append(";")
                        lines.append(line - 1)
                    if language == "python" and group == "nl" and not depth:
                        if out and out[-1] not in ("NL", "INDENT", "DEDENT"):
                            out.append("NL")
                            lines.append(line - 1)
                        begin = True
                continue
            if group == "name":
                word = m.group()
                kind = word if word in words else "LIFE" if word[0] == "'" else "ID"
            elif group == "string":
                kind = "STR"
            elif group == "number":
                kind = "NUM"
                if language == "python" and re.match(r"0[\d_]*[1-9][\d_]*$", m.group()):
                    kind = "ERR"
            elif group == "op":
                kind = operators[m.group()]
                if language == "python":
                    depth = depth + (kind in "([{") - (kind in ")]}") if len(kind) == 1 else depth
                    depth = max(depth, 0)
            elif group == "conflict":
                kind, depth = "CONFLICT", 0 if language == "python" else depth
            elif group == "broken":
                kind = "ERR"
                end = n if m.group() == "/*" or text[at:].startswith(('"""', "'''")) else (e if (e := text.find("\n", at)) >= 0 else n)
            elif m.group() == "\\" and language == "python" and text[end : end + 1] == "\n":
                at = end + 1
                line += 1
                continue
            else:
                kind = "ERR"
        if script and fresh and out and out[-1] in _ASI_AFTER and kind not in _NO_ASI_BEFORE:
            out.append(";")
            lines.append(line)
        fresh = False
        out.append(kind)
        lines.append(line)
        line += text.count("\n", at, end)
        at = end
    if language == "python":
        if out and out[-1] not in ("NL", "INDENT", "DEDENT"):
            out.append("NL")
            lines.append(line)
        for _ in indent[1:]:
            out.append("DEDENT")
            lines.append(line)
    if language == "go" and out and out[-1] in _GO_END:
        out.append(";")
        lines.append(line)
    return out, lines


_PYTHON = """
file = (NL | stmt)*
stmt = small (';' small)* ';'? NL | block
small = value | 'return' tests? | 'pass' | 'break' | 'continue' | 'import' dotted ('as' ID)? (',' dotted ('as' ID)?)* | 'from' ('.' | '...')* dotted? 'import' ('*' | names | '(' names ','? ')')
  | 'raise' (test ('from' test)?)? | ('global' | 'nonlocal') ID (',' ID)* | 'del' targets | 'assert' test (',' test)? | 'import' dotted
dotted = ID ('.' ID)*
names = ID ('as' ID)? (',' ID ('as' ID)?)*
value = (targets '=')* (tests | yield) | place ':' test ('=' (tests | yield))? | place ASG (tests | yield) | 'type' ID generic? '=' test
yield = 'yield' ('from' test | tests)?
block = 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)? | 'while' named ':' suite ('else' ':' suite)? | 'async'? 'for' targets 'in' tests ':' suite ('else' ':' suite)?
  | 'try' ':' suite (('except' '*'? (test (',' test)* ('as' ID)?)? ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)? | 'finally' ':' suite) | 'async'? 'with' (withitem (',' withitem)* | '(' withitem (',' withitem)* ','? ')') ':' suite
  | decorator* ('async'? 'def' ID generic? '(' params? ')' ('->' test)? ':' suite | 'class' ID generic? ('(' args? ')')? ':' suite) | 'match' tests ':' NL INDENT ('case' pattern (',' pattern)* ','? ('if' named)? ':' suite)+ DEDENT
pattern = '*'? test ('as' ID)?
decorator = '@' named NL
generic = '[' ('*' | '**')? ID (':' test)? (',' ('*' | '**')? ID (':' test)?)* ','? ']'
withitem = test ('as' target)?
suite = small (';' small)* ';'? NL | NL INDENT stmt+ DEDENT
params = param (',' param)* ','?
param = ID (':' test)? ('=' test)? | '*' (ID (':' star)?)? | '**' ID (':' test)? | BOP
targets = target (',' target)* ','?
target = '*'? (place | '(' targets? ')' | '[' targets? ']')
place = ID | '(' place ')' | prim ('.' ID | '(' args? ')' | '[' subs ']')* ('.' ID | '[' subs ']')
tests = star (',' star)* ','?
star = '*' test | named
named = (ID ':=')? test
test = chain ('if' chain 'else' test)? | 'lambda' params? ':' test
$bop = BOP | '+' | '-' | '*' | '**' | '@' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' 'not'?
chain = unary ($bop unary)*
unary = ('not' | '-' | '+' | '~' | 'await')* post
post = prim ('.' ID | '(' args? ')' | '[' subs ']')*
prim = ID | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' (tests | yield | named comp)? ')' | '[' (tests | named comp)? ']' | '{' (entry (',' entry)* ','? | entry comp)? '}'
entry = test ':' test | '**' chain | star
comp = ('async'? 'for' targets 'in' chain ('if' (ID ':=')? chain)*)+
args = arg (',' arg)* ','?
arg = named comp? | ID '=' test | '*' test | '**' test
subs = sub (',' sub)* ','?
sub = star | test? ':' test? (':' test?)?
"""

_SCRIPT = """
file = item*
item = stmt | 'import' %(TYPE)s (clause 'from')? STR ('with' object)? ';' | 'export' (decl | 'default' (assign ';' | function | class) | '*' ('as' $name)? 'from' STR ';' | %(TYPE)s '{' specs? '}' ('from' STR)? ';') %(ITEM)s
clause = $id (',' (named | '*' 'as' $id))? | named | '*' 'as' $id
named = '{' specs? '}'
specs = spec (',' spec)* ','?
spec = %(TYPE)s ($name | STR) ('as' ($name | STR))?
$id = ID | 'of' | 'async' | 'from' | 'as' | 'get' | 'set' | 'static' | 'let' | 'await' | 'yield' %(IDS)s
$name = $id | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with'
decl = vars ';' | function | class %(DECL)s
vars = ('var' | 'let' | 'const') bind (',' bind)*
bind = ($id | pattern) %(BINDTYPE)s ('=' assign)?
pattern = '{' (pprop (',' pprop)* ','?)? '}' | '[' (pelem? ',')* pelem? ']'
pprop = '...' $id | key (':' pelem | '=' assign)?
pelem = '...'? ($id | pattern) ('=' assign)?
function = 'async'? 'function' '*'? $id? signature (block %(OVERLOAD)s)
signature = %(GENERIC)s '(' params? ')' %(RETURN)s
params = param (',' param)* ','?
param = %(PARAMMODS)s '...'? ($id | pattern | 'this') %(PARAMTYPE)s ('=' assign)?
class = %(ABSTRACT)s 'class' $id? %(GENERIC)s ('extends' post %(TARGS)s)? %(IMPLEMENTS)s '{' member* '}'
member = ';' | %(MEMBERMODS)s 'static'? %(MEMBERMODS2)s ('async' | 'get' | 'set')? '*'? mkey (%(OPT)s signature (block %(OVERLOAD)s) | %(BINDTYPE2)s ('=' assign)? ';') | 'static' block
mkey = key | '#' $name
key = $name | STR | NUM | '[' assign ']'
block = '{' stmt* '}'
stmt = block | ';' | decl | exprs ';' | 'if' '(' exprs ')' stmt ('else' stmt)? | 'for' 'await'? '(' (vars | exprs)? ';' exprs? ';' exprs? ')' stmt | 'for' 'await'? '(' (('var' | 'let' | 'const') ($id | pattern) | post) ('of' assign | 'in' exprs) ')' stmt
  | 'while' '(' exprs ')' stmt | 'do' stmt 'while' '(' exprs ')' ';'? | 'return' exprs? ';' | 'throw' exprs ';' | ('break' | 'continue') $id? ';' | 'debugger' ';' | ID ':' stmt | 'with' '(' exprs ')' stmt
  | 'try' block ('catch' ('(' ($id | pattern) %(BINDTYPE3)s ')')? block ('finally' block)? | 'finally' block) | 'switch' '(' exprs ')' '{' (('case' exprs | 'default') ':' stmt*)* '}'
exprs = assign (',' assign)*
$bop = BOP | '+' | '-' | '*' | '<' | '>' ('>' '>'?)? | '>' '=' | 'in' | 'instanceof' %(BOPS)s
assign = chain ('?' assign ':' assign | ('=' | ASG) assign)? | arrow
arrow = 'async'? ($id | signature) '=>' (assign | block)
chain = unary ($bop unary)* %(AS)s
unary = ('!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--' | 'yield' '*'?)* post
post = ('new' ('.' $name)?)* prim ('.' '#'? $name | '?.' ($name | '[' exprs ']' | '(' args? ')') | '(' args? ')' | '[' exprs ']' | TMPL | '++' | '--' %(POST)s)*
prim = $id | NUM | STR | TMPL | RE | JSX | 'this' | 'super' | 'null' | 'true' | 'false' | '(' exprs ')' | '[' (arg? ',')* arg? ']' | object | function | class | 'import'
args = arg (',' arg)* ','?
arg = '...'? assign
object = '{' (prop (',' prop)* ','?)? '}'
prop = key ':' assign | $id ('=' assign)? | '...' assign | ('async' | 'get' | 'set')? '*'? key signature block
"""
_PLAIN = dict.fromkeys("TYPE ITEM IDS DECL BINDTYPE BINDTYPE2 BINDTYPE3 OVERLOAD GENERIC RETURN PARAMMODS PARAMTYPE ABSTRACT TARGS IMPLEMENTS MEMBERMODS MEMBERMODS2 OPT BOPS AS POST".split(), "")
_TYPED = dict(
    TYPE="'type'?", ITEM="| 'export' ('=' exprs ';' | 'as' 'namespace' $id ';') | 'import' $id '=' exprs ';'", IDS="| 'type' | 'declare' | 'abstract' | 'readonly' | 'keyof' | 'infer' | 'is' | 'namespace' | 'module' | 'satisfies' | 'interface' | 'enum' | 'implements' | 'public' | 'private' | 'protected'",
    DECL="| 'interface' $id generic? ('extends' type (',' type)*)? body ';'? | 'type' $id generic? '=' type ';' | 'const'? 'enum' $id '{' (key ('=' assign)? (',' key ('=' assign)?)* ','?)? '}' | 'declare' (decl | item) | ('namespace' | 'module') ($id ('.' $id)* | STR) '{' item* '}'",
    BINDTYPE="'!'? (':' type)?", BINDTYPE2="('?' | '!')? (':' type)?", BINDTYPE3="(':' type)?", OVERLOAD="| ';'", GENERIC="generic?", RETURN="(':' ($id 'is')? type)?", PARAMMODS="decorator* ('public' | 'private' | 'protected' | 'readonly')*", PARAMTYPE="'?'? (':' type)?",
    ABSTRACT="decorator* 'abstract'?", TARGS="targs?", IMPLEMENTS="('implements' type (',' type)*)?", MEMBERMODS="decorator* ('public' | 'private' | 'protected' | 'declare' | 'abstract')*", MEMBERMODS2="('abstract' | 'readonly')*", OPT="'?'?", BOPS="| '|' | '&'", AS="(('as' | 'satisfies') ('const' | type))*",
    POST="| '!' | targs '(' args? ')'",
)
_TYPES = """
decorator = '@' post
generic = '<' gparam (',' gparam)* ','? '>'
gparam = 'const'? $id ('extends' type)? ('=' type)?
targs = '<' type (',' type)* '>'
type = '|'? tpost (('|' | '&') tpost)* ('extends' type '?' type ':' type)? | generic? '(' params? ')' '=>' type | 'new' '(' params? ')' '=>' type
tpost = ('keyof' | 'typeof' | 'readonly' | 'infer')* tprim ('[' type? ']')*
tprim = $id ('.' $name)* targs? | STR | NUM | '-' NUM | 'null' | 'void' | 'this' | 'true' | 'false' | TMPL | body | '(' type ')' | '[' (tuple (',' tuple)* ','?)? ']' | 'import' '(' STR ')' ('.' $name)*
tuple = '...'? ($id '?'? ':')? type '?'?
body = '{' ((sig | '[' $id ('in' type | ':' type) ('as' type)? ']' '?'? ':' type | '[' $id ':' type ']' ':' type) (';' | ',')?)* '}'
sig = 'readonly'? ('get' | 'set')? key '?'? (':' type | signature)? | 'new'? signature
"""

_C_EXPRESSIONS = """
exprs = assign (',' assign)*
assign = chain ('?' assign ':' assign | ('=' | ASG) assign)? | lambda
chain = unary ($bop unary | 'instanceof' (shape | type))*
args = assign (',' assign)*
"""
_JAVA = """
file = (mods 'package' qname ';')? (import | ';')* (typedecl | ';')*
import = 'import' 'static'? qname ('.' '*')? ';'
qname = ID ('.' ID)*
mods = ('public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | annotation)*
annotation = '@' qname ('(' (annvalue (',' annvalue)*)? ')')?
annvalue = (ID '=')? (assign | annotation | '{' (annvalue (',' annvalue)*)? ','? '}')
typedecl = mods (('sealed' | 'non' '-' 'sealed') mods)? ('class' ID generic? ('extends' type)? ('implements' types)? ('permits' types)? body | 'interface' ID generic? ('extends' types)? ('permits' types)? body | 'enum' ID ('implements' types)? '{' (constant (',' constant)*)? ','? (';' member*)? '}' | '@' 'interface' ID body | 'record' ID generic? '(' params? ')' ('implements' types)? body)
constant = annotation* ID ('(' args? ')')? body?
generic = '<' gparam (',' gparam)* '>'
gparam = annotation* ID ('extends' type ('&' type)*)?
types = type (',' type)*
body = '{' member* '}'
member = ';' | typedecl | 'static'? block | mods generic? (type | 'void') ID '(' params? ')' dims ('throws' types)? (block | ('default' annvalue)? ';') | mods generic? ID '(' params? ')' ('throws' types)? block | mods ID block | mods type vars ';'
dims = ('[' ']')*
vars = var (',' var)*
var = ID dims ('=' (assign | init))?
init = '{' ((assign | init) (',' (assign | init))*)? ','? '}'
params = param (',' param)*
param = ('final' | annotation)* type '...'? (ID | 'this') dims
$prim = 'int' | 'char' | 'long' | 'short' | 'byte' | 'boolean' | 'float' | 'double'
type = annotation* ($prim | ID targs? ('.' ID targs?)*) ('[' ']')*
targs = '<' (targ (',' targ)*)? '>'
targ = type | annotation* '?' (('extends' | 'super') type)?
block = '{' stmt* '}'
stmt = block | ';' | typedecl | ('final' | annotation)* type vars ';' | exprs ';' | 'if' '(' exprs ')' stmt ('else' stmt)? | 'while' '(' exprs ')' stmt | 'do' stmt 'while' '(' exprs ')' ';' | 'for' '(' (('final' | annotation)* type vars | exprs)? ';' exprs? ';' exprs? ')' stmt | 'for' '(' ('final' | annotation)* type ID ':' exprs ')' stmt
  | 'return' exprs? ';' | 'throw' exprs ';' | ('break' | 'continue') ID? ';' | 'assert' assign (':' assign)? ';' | 'synchronized' '(' exprs ')' block | ID ':' stmt | switch
  | 'try' ('(' resource (';' resource)* ';'? ')')? block ('catch' '(' ('final' | annotation)* type (BOP type)* ID ')' block)* ('finally' block)? | 'yield' assign ';'
resource = 'final'? type ID '=' assign | post
switch = 'switch' '(' exprs ')' '{' (('case' labels | 'default') (':' stmt* | '->' (exprs ';' | block | 'throw' exprs ';')))* '}'
labels = label (',' label)*
label = (assign | shape | 'default') ('when' exprs)?
shape = ('final' | annotation)* type (ID | '(' (shape (',' shape)*)? ')' ID?)
$bop = BOP | '+' | '-' | '*' | '&' | '<' | '>' ('>' '>'?)?
lambda = (ID | '(' (ID (',' ID)* | params)? ')') '->' (assign | block)
unary = ('!' | '~' | '+' | '-' | '++' | '--' | '(' type ('&' type)* ')')* post
post = prim ('.' targs? (ID | 'class' | 'this' | 'super' | 'new' ID) | '(' args? ')' | '[' exprs ']' | '++' | '--' | '::' (ID | 'new'))*
prim = ID targs? | NUM | STR | 'this' | 'super' | 'null' | 'true' | 'false' | '(' exprs ')' | 'new' ctype ('(' args? ')' body? | ('[' exprs? ']')+ init?) | ($prim | 'void') ('[' ']')* ('.' 'class' | '::' 'new') | ID ('[' ']')+ ('.' 'class' | '::' 'new') | switch
ctype = ($prim | ID targs? ('.' ID targs?)*)
""" + _C_EXPRESSIONS

_GO = """
file = 'package' ID ';' ('import' (spec | '(' (spec ';')* spec? ')') ';')* (decl ';' | ';')*
spec = (ID | '.')? STR
decl = vardecl | 'func' ('(' params? ')')? ID generic? '(' params? ')' result? block?
vardecl = ('var' | 'const') (var | '(' (var ';')* var? ')') | 'type' (tspec | '(' (tspec ';')* tspec? ')')
var = ID (',' ID)* type? ('=' exprs)?
tspec = ID generic? '='? type
generic = '[' ID (',' ID)* constraint (',' ID (',' ID)* constraint)* ','? ']'
constraint = '~'? type (BOP '~'? type)*
params = param (',' param)* ','?
param = ID? '...'? type
result = type | '(' params? ')'
type = qual ('[' type (',' type)* ']')? | '*' type | '[' (expr | '...')? ']' type | 'map' '[' type ']' type | '<-'? 'chan' '<-'? type | 'func' '(' params? ')' result? | 'struct' '{' (field ';')* field? '}' | 'interface' '{' (method ';')* method? '}' | '(' type ')'
qual = ID ('.' ID)?
field = (ID (',' ID)* type | '*'? qual) STR?
method = ID '(' params? ')' result? | constraint
block = '{' (stmt? ';')* stmt? '}'
simple = exprs (('=' | ':=' | ASG) exprs | '++' | '--' | '<-' expr)? 
stmt = vardecl | simple | block | ('go' | 'defer') expr | 'return' exprs? | ('break' | 'continue' | 'goto') ID? | 'fallthrough' | if | ID ':' stmt? | 'for' ((simple? ';' hexpr? ';' simple?) | (hexprs ('=' | ':='))? 'range' hexpr | hexpr)? block
  | 'switch' (simple? ';')? simple? '{' (('case' (exprs | type (',' type)*) | 'default') ':' (stmt? ';')* stmt?)* '}' | 'select' '{' (('case' simple | 'default') ':' (stmt? ';')* stmt?)* '}'
if = 'if' (simple ';')? hexpr block ('else' (if | block))?
hexprs = hexpr (',' hexpr)*
hexpr = expr
exprs = expr (',' expr)*
$bop = BOP | '+' | '-' | '*' | '&' | '^' | '<' | '>'
expr = unary ($bop unary)*
unary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* post
post = prim ('.' (ID | '(' ('type' | type) ')') | '(' (arg (',' arg)* ','?)? '...'? ','? ')' | '[' (expr | type) (',' type)* ']' | '[' expr? ':' expr? (':' expr)? ']' | literal)*
arg = expr '...'? | type
prim = ID | NUM | STR | '(' (expr | type) ')' | 'func' '(' params? ')' result? block | ('[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'struct' '{' (field ';')* field? '}') (literal | '(' expr ')') | 'chan' type | 'interface' '{' '}'
literal = '{' (element (',' element)* ','?)? '}'
element = (expr | literal) (':' (expr | literal))?
"""

_RUST = """
file = inner* item*
inner = '#' '!' tree
tree = '(' any* ')' | '[' any* ']' | '{' any* '}'
any = tree | ID | NUM | STR | LIFE | BOP | ASG | %(TOKENS)s
outer = '#' tree
vis = 'pub' ('(' ('crate' | 'self' | 'super' | 'in' path) ')')?
item = outer* vis? (fn | 'use' usetree ';' | 'mod' ID (';' | '{' inner* item* '}') | 'struct' ID generic? where? (';' | '(' (outer* vis? type (',' outer* vis? type)* ','?)? ')' where? ';' | '{' (sfield (',' sfield)* ','?)? '}') | 'enum' ID generic? where? '{' (variant (',' variant)* ','?)? '}'
  | 'unsafe'? 'impl' generic? '!'? type ('for' type)? where? '{' inner* item* '}' | 'unsafe'? 'trait' ID generic? (':' bounds?)? where? '{' inner* item* '}' | 'type' ID generic? (':' bounds)? where? ('=' type)? ';' | ('const' | 'static') 'mut'? ID (':' type)? ('=' expr)? ';' | 'extern' (STR? '{' item* '}' | 'crate' ID ('as' ID)? ';') | macro ';'?) | ID '!' ID tree
macro = path '!' tree
fn = 'const'? 'async'? 'unsafe'? ('extern' STR?)? 'fn' ID generic? '(' (self | param (',' param)*)? ','? ')' ('->' type)? where? (block | ';')
self = outer* (('&' LIFE?)? 'mut'? 'self' (':' type)?) (',' param)*
param = outer* pat ':' type
usetree = '::'? (useseg '::')* (useseg ('as' ID)? | '*' | '{' (usetree (',' usetree)* ','?)? '}')
useseg = ID | 'self' | 'super' | 'crate'
sfield = outer* vis? ID ':' type
variant = outer* ID ('(' (vis? type (',' vis? type)* ','?)? ')' | '{' (sfield (',' sfield)* ','?)? '}')? ('=' expr)?
generic = '<' (gparam (',' gparam)* ','?)? '>'
gparam = LIFE (':' LIFE ('+' LIFE)*)? | 'const' ID ':' type ('=' expr)? | ID (':' bounds?)? ('=' type)?
where = 'where' (wpred (',' wpred)* ','?)?
wpred = (type | LIFE) ':' bounds?
bounds = bound ('+' bound)*
bound = LIFE | '?'? ('for' generic)? path | '(' bound ')'
path = '::'? seg ('::' seg)*
seg = (ID | 'self' | 'Self' | 'super' | 'crate') (targs | '(' (type (',' type)*)? ')' '->' type)?
targs = '<' (targ (',' targ)* ','?)? '>'
targ = LIFE | type | ID '=' type | NUM | block
type = path | '&' LIFE? 'mut'? type | '&&' LIFE? 'mut'? type | '*' ('const' | 'mut') type | '[' type (';' expr)? ']' | '(' (type (',' type)* ','?)? ')' | '!' | ('dyn' | 'impl') bounds | 'unsafe'? ('extern' STR?)? 'fn' '(' (type (',' type)*)? ')' ('->' type)? | '<' type ('as' path)? '>' '::' seg ('::' seg)* | macro
block = '{' inner* stmt* expr? '}'
stmt = ';' | item | outer* 'let' pat (':' type)? ('=' expr ('else' block)?)? ';' | expr ';' | blocky
blocky = outer* (LIFE ':')? ('if' cond block ('else' blockyelse)? | 'match' expr '{' inner* (arm)* '}' | 'while' cond block | 'for' pat 'in' expr block | 'loop' block | 'unsafe'? block) | macro
blockyelse = block | 'if' cond block ('else' blockyelse)?
cond = ('let' pat '=')? expr
arm = outer* '|'? pat ('if' cond)? '=>' (expr ','? | block ','?)
pat = patalt ('|' patalt)*
patalt = ('ref'? 'mut'? ID ('@' pat)?) | 'ref' 'mut'? ID | '-'? NUM (('..=' | '..' | '...') '-'? NUM?)? | STR (('..=' | '..') STR)? | 'true' | 'false' | path ('(' (pat (',' pat)* ','?)? ')' | '{' ((fpat | '..') (',' (fpat | '..'))* ','?)? '}')? | '&' 'mut'? patalt | '(' (pat (',' pat)* ','?)? ')' | '[' (pat (',' pat)* ','?)? ']' | '..' | '_' | macro
fpat = (ID ':' pat) | 'ref'? 'mut'? ID
$bop = BOP | '+' | '-' | '*' | '&' | '|' | '&&' | '||' | '<' | '>' '>'? | '>' '=' | '..' | '..='
expr = unary ($bop unary)* (('=' | ASG) expr)? '..'? | '..' unary? | 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | 'move'? ('|' (cparam (',' cparam)* ','?)? '|' | '||') ('->' type)? expr
cparam = pat (':' type)?
unary = ('-' | '!' | '*' | ('&' | '&&') 'mut'?)* post
post = prim ('.' (ID | NUM | 'await') ('::' targs)? | '(' args? ')' | '[' expr ']' | '?' | 'as' type)*
args = expr (',' expr)* ','?
prim = epath | NUM | STR | 'true' | 'false' | '(' (expr (',' expr)* ','?)? ')' | '[' (args | expr ';' expr)? ']' | blocky | 'async' 'move'? block | epath '{' ((ID | NUM) (':' expr)? (',' (ID | NUM) (':' expr)?)* ','? ('..' expr)? | '..' expr)? '}' | '<' type ('as' path)? '>' '::' epath
epath = '::'? eseg ('::' (eseg | targs))*
eseg = ID | 'self' | 'Self' | 'super' | 'crate'
"""

_CSHARP = """
file = ('extern' 'alias' ID ';' | using)* member*
using = 'global'? 'using' 'static'? (ID '=')? type ';'
attr = '[' (ID ':')? post (',' post)* ','? ']'
$mods = ('public' | 'private' | 'protected' | 'internal' | 'static' | 'abstract' | 'sealed' | 'virtual' | 'override' | 'readonly' | 'const' | 'extern' | 'unsafe' | 'volatile' | 'new' | 'event' | 'fixed' | 'ref' | 'partial' | 'async' | 'required' | 'file')*
mods = attr* $mods
member = ';' | 'namespace' qname (';' using* | '{' using* member* '}' ';'?) | mods typedecl | mods (type | 'void') ('operator' $anyop | (type '.')? ID) generic? '(' params? ')' wheres (block | '=>' exprs ';' | ';') | mods ID '(' params? ')' (':' ('base' | 'this') '(' args? ')')? (block | '=>' exprs ';' | ';') | mods '~' ID '(' ')' block
  | mods ('implicit' | 'explicit') 'operator' type '(' params ')' (block | '=>' exprs ';') | mods type vars ';' | mods type (type '.')? (ID | 'this' '[' params ']') ('{' accessor+ '}' ('=' exprs ';')? | '=>' exprs ';') | mods 'delegate' type ID generic? '(' params? ')' wheres ';' | mods 'delegate' 'void' ID generic? '(' params? ')' wheres ';'
$anyop = BOP | '+' | '-' | '*' | '!' | '~' | '<' | '>' | '&' | 'true' | 'false' | '++' | '--'
typedecl = ('class' | 'struct' | 'interface' | 'record' ('class' | 'struct')?) ID generic? ('(' params? ')')? (':' type ('(' args? ')')? (',' type)*)? wheres ('{' member* '}' ';'? | ';') | 'enum' ID (':' type)? '{' (attr* ID ('=' assign)? (',' attr* ID ('=' assign)?)* ','?)? '}' ';'?
wheres = ('where' ID ':' (type | 'class' | 'struct' | 'new' '(' ')') (',' (type | 'class' | 'struct' | 'new' '(' ')'))*)*
accessor = attr* $mods ('get' | 'set' | 'init' | 'add' | 'remove') (block | '=>' exprs ';' | ';')
qname = ID ('.' ID)*
generic = '<' attr* ('in' | 'out')? ID (',' attr* ('in' | 'out')? ID)* '>'
params = param (',' param)*
param = attr* ('ref' | 'out' | 'in' | 'params' | 'this')* type ID ('=' assign)?
vars = var (',' var)*
var = ID ('=' (assign | init))? | ID '[' exprs ']'
init = '{' ((assign | init) (',' (assign | init))*)? ','? '}'
$prim = 'int' | 'char' | 'long' | 'short' | 'byte' | 'bool' | 'float' | 'double' | 'string' | 'object' | 'decimal' | 'uint' | 'ulong' | 'ushort' | 'sbyte'
type = ($prim | (ID '::')? ID targs? ('.' ID targs?)* | '(' type ID? (',' type ID?)+ ')') ('?' | '*' | '[' ','* ']')*
targs = '<' (type (',' type)* | ','*) '>'
block = '{' stmt* '}'
stmt = block | ';' | ('const' | 'await'? 'using' | 'ref')? type vars ';' | exprs ';' | 'if' '(' exprs ')' stmt ('else' stmt)? | 'while' '(' exprs ')' stmt | 'do' stmt 'while' '(' exprs ')' ';' | 'for' '(' (type vars | exprs)? ';' exprs? ';' exprs? ')' stmt | 'await'? 'foreach' '(' type (ID | '(' ID (',' ID)* ')') 'in' exprs ')' stmt
  | 'return' exprs? ';' | 'throw' exprs? ';' | ('break' | 'continue') ';' | 'goto' ('case' exprs | 'default' | ID) ';' | 'yield' ('return' exprs | 'break') ';' | ('lock' | 'fixed' | 'using') '(' (type vars | exprs) ')' stmt | ('checked' | 'unchecked' | 'unsafe') block | ID ':' stmt
  | 'try' block ('catch' ('(' type ID? ')')? ('when' '(' exprs ')')? block)* ('finally' block)? | 'switch' '(' exprs ')' '{' ((('case' pattern ('when' assign)? | 'default') ':')+ stmt+)* '}' | mods (type | 'void') ID generic? '(' params? ')' (block | '=>' exprs ';')
pattern = 'not'* (type ID? | operands | ('<' | '>') '='? operands | BOP operands | type? '{' ((property (',' property)*) ','?)? '}' ID?) (('and' | 'or') pattern)?
property = ID ('.' ID)* ':' pattern
operands = unary ($bop unary)*
$bop = BOP | '+' | '-' | '*' | '&' | '<' | '>' ('>' '>'?)? | '>' '=' | '..'
lambda = 'static'? 'async'? ((ID | '(' (lparam (',' lparam)*)? ')') '=>' (assign | block) | 'delegate' ('(' params? ')')? block) | 'throw' assign
lparam = ('ref' | 'out' | 'in')? type? ID
exprs = assign (',' assign)*
assign = chain ('?' assign ':' assign | ('=' | ASG) assign)? | lambda | query
query = 'from' type? ID 'in' assign clauses
clauses = ('from' type? ID 'in' assign | 'where' assign | 'let' ID '=' assign | 'join' type? ID 'in' assign 'on' assign 'equals' assign ('into' ID)? | 'orderby' assign ('ascending' | 'descending')? (',' assign ('ascending' | 'descending')?)*)* ('select' assign | 'group' assign 'by' assign) ('into' ID clauses)?
chain = unary ($bop unary | 'is' pattern | 'as' type)*
unary = ('!' | '~' | '+' | '-' | '++' | '--' | '&' | '*' | '(' type ')' | '..' | 'ref' | 'await')* post
args = arg (',' arg)*
arg = (ID ':')? ('ref' | 'in' | 'out' type?)? assign | 'out' type ID
post = prim ('.' ID targs? | '?.' ID targs? | '?.'? '[' args ']' | '?' '[' args ']' | '(' args? ')' | '++' | '--' | '!' | '::' ID | 'with' init | 'switch' '{' (sarm (',' sarm)* ','?)? '}')*
sarm = pattern ('when' assign)? '=>' assign
prim = ID targs? | NUM | STR | 'this' | 'base' | 'null' | 'true' | 'false' | '(' exprs ')' | $prim | ('typeof' | 'sizeof') '(' (type | 'void') ')' | 'default' ('(' type ')')? | ('checked' | 'unchecked') '(' exprs ')' | 'new' (ctype ('(' args? ')' init? | init | '[' exprs ']' ('[' ','* ']')* init? | ('[' ','* ']')+ init) | '(' args? ')' init? | '[' ','* ']' init | init) | '[' (args ','?)? ']' | 'stackalloc' type '[' exprs ']'
ctype = $prim | ID targs? ('.' ID targs?)*
"""

_CPP = """
file = decl*
attr = '[' '[' (ID ('::' ID)? ('(' args? ')')? ','?)* ']' ']'
decl = ';' | 'namespace' (ID ('::' ID)*)? '{' decl* '}' | 'inline' 'namespace' ID '{' decl* '}' | 'using' ('namespace' qid | qid | 'typename'? ID '=' typeid) ';' | 'template' '<' tparams? '>' decl | 'extern' STR ('{' decl* '}' | decl) | 'static_assert' '(' args ')' ';' | 'typedef' type declr (',' declr)* ';' | class declrs? ';' | enum ';' | function | mods type declrs ';' | 'friend' (decl | type ';') | ('public' | 'private' | 'protected') ID? ':' | 'template' qid ';' | ID '(' args? ')' ';'?
tparams = tparam (',' tparam)*
tparam = ('typename' | 'class') '...'? ID? ('=' typeid)? | type declr? ('=' unary)? | 'template' '<' tparams '>' ('class' | 'typename') ID
$mods = ('static' | 'extern' | 'inline' | 'constexpr' | 'consteval' | 'virtual' | 'explicit' | 'mutable' | 'thread_local' | 'friend' | attr)*
mods = $mods
class = $mods ('class' | 'struct' | 'union') attr? qid? 'final'? (':' base (',' base)*)? '{' decl* '}'
base = ('public' | 'private' | 'protected' | 'virtual')* qid
enum = 'enum' ('class' | 'struct')? ID? (':' type)? ('{' (ID ('=' assign)? (',' ID ('=' assign)?)* ','?)? '}')? declrs?
function = $mods type? ('*' | '&' | '&&' | 'const')* fname '(' params? ')' tail (block | ';' | '=' ('default' | 'delete' | NUM) ';' | ':' minit (',' minit)* block | 'try' block handlers)
tail = ('const' | 'noexcept' ('(' exprs ')')? | 'override' | 'final' | 'volatile' | '&' | '&&' | '->' typeid | attr)*
minit = qid ('(' args? ')' | '{' args? '}') '...'?
fname = (qid '::')? ('operator' ($anyop | typeid) | '~' ID) | qid
$anyop = BOP | ASG | '+' | '-' | '*' | '&' | '&&' | '<' | '>' '>'? | '>' '=' | '=' | '!' | '~' | '++' | '--' | '->' | '(' ')' | '[' ']' | ',' | 'new' | 'delete' | STR ID
qid = '::'? seg ('::' 'template'? (seg | '~' ID))*
seg = ID targs?
targs = '<' (targ (',' targ)*)? '>'
targ = typeid '...'? | chainless
chainless = unary (('+' | '-' | '*' | BOP) unary)*
$prim = 'int' | 'char' | 'long' | 'short' | 'signed' | 'unsigned' | 'bool' | 'float' | 'double' | 'wchar_t' | 'void' | 'auto'
type = ('const' | 'volatile' | 'constexpr' | 'static')* ($prim+ | 'typename'? qid | ('class' | 'struct' | 'enum' | 'union') qid | 'decltype' '(' exprs ')') ('const' | 'volatile')*
typeid = type ('*' | '&' | '&&' | 'const')* ('(' ('*' ID?)? params? ')' ('(' params? ')')?)? ('[' exprs? ']')*
declrs = declr (',' declr)*
declr = ('*' | '&' | '&&' | 'const')* (qid | '[' ID (',' ID)* ']' | '(' '*' ID ')' '(' params? ')') ('[' exprs? ']')* (':' NUM)? ('=' (assign | init) | init | '(' args? ')')?
init = '{' ((assign | init | '.' ID '=' (assign | init)) (',' (assign | init | '.' ID '=' (assign | init)))*)? ','? '}'
params = param (',' param)* (',' '...')? | '...' | 'void'
param = attr? type ('*' | '&' | '&&' | 'const')* '...'? (ID | '(' ('*' | '&') ID? ')' ('(' params? ')')?)? ('[' exprs? ']')* ('=' (assign | init))?
block = '{' stmt* '}'
handlers = ('catch' '(' (param | '...') ')' block)+
stmt = block | ';' | attr stmt | simpledecl | exprs ';' | 'if' 'constexpr'? '(' (simpledecl)? cond ')' stmt ('else' stmt)? | 'while' '(' cond ')' stmt | 'do' stmt 'while' '(' exprs ')' ';' | 'for' '(' (simpledecl | exprs? ';') exprs? ';' exprs? ')' stmt | 'for' '(' mods type ('*' | '&' | '&&' | 'const')* (ID | '[' ID (',' ID)* ']') ':' (exprs | init) ')' stmt
  | 'return' (exprs | init)? ';' | 'throw' exprs? ';' | ('break' | 'continue') ';' | 'goto' ID ';' | 'switch' '(' cond ')' stmt | ('case' assign | 'default') ':' stmt? | ID ':' stmt | 'try' block handlers
cond = exprs | type ('*' | '&' | '&&' | 'const')* ID ('=' assign | init)
simpledecl = mods type declrs ';' | 'using' ('namespace' qid | qid | ID '=' typeid) ';' | class declrs? ';' | enum ';' | 'typedef' type declr ';' | 'static_assert' '(' args ')' ';'
$bop = BOP | '+' | '-' | '*' | '&' | '&&' | '<' | '>' '>'? | '>' '=' | '->*'
lambda = '[' (('&' | '=' | ('&'? (ID | 'this' | '*' 'this') ('=' assign)?)) (',' ('&'? (ID | 'this') ('=' assign)?))*)? ']' ('<' tparams '>')? ('(' params? ')')? ('mutable' | 'noexcept' | 'constexpr' | '->' typeid)* block
unary = ('!' | '~' | '+' | '-' | '++' | '--' | '&' | '*' | 'sizeof' '...'? | 'throw' | '(' typeid ')' | 'delete' ('[' ']')?)* post
post = prim ('.' 'template'? (seg | '~' ID) | '->' 'template'? (seg | '~' ID) | '(' args? ')' | '[' (exprs | init) ']' | '++' | '--' | init | '...')*
prim = qid | NUM | STR+ ID? | 'this' | 'nullptr' | 'true' | 'false' | '(' exprs ')' | lambda | $prim+ ('(' args? ')' | init) | ('static_cast' | 'const_cast' | 'dynamic_cast' | 'reinterpret_cast') '<' typeid '>' '(' exprs ')' | 'new' ('(' args ')')? type '*'* ('(' args? ')' | init | '[' exprs ']')? | ('typeid' | 'sizeof' | 'noexcept' | 'decltype') '(' (typeid | exprs) ')' | 'typename' qid ('(' args? ')' | init)
exprs = assign (',' assign)*
assign = chain ('?' assign ':' assign | ('=' | ASG) (assign | init))?
chain = unary ($bop unary)*
args = (assign | init) (',' (assign | init))*
"""


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    if language == "javascript":
        return Grammar(_SCRIPT % _PLAIN, ";", ("}", "<end>"))
    if language == "typescript":
        return Grammar((_SCRIPT % _TYPED).rstrip() + "\n" + _TYPES.lstrip(), ";", ("}", "<end>"))
    if language == "go":
        return Grammar(_GO)
    if language == "rust":
        tokens = {*_WORDS["rust"].split(), *_OTHER["rust"].split()} - set("()[]{}")
        return Grammar(_RUST % {"TOKENS": " | ".join(f"'{t}'" for t in sorted(tokens))})
    return Grammar({"python": _PYTHON, "java": _JAVA, "csharp": _CSHARP, "cpp": _CPP}[language], soft=tuple(_SOFT.get(language, "").split()))


@lru_cache(maxsize=None)
def shared_chart(language: str) -> SharedChart:
    """The worker's chart of a language, filled by all texts that it reads."""
    return SharedChart(grammar(language))
