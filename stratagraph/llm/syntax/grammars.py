"""Syntax of the languages in the notation of ``engine``.

Written from the public language specifications: Go 1.22, Python 3.13, TypeScript 5, ECMAScript 2022 modules,
Java 17, Rust 2021 and C17. Operator precedence is left out: it never decides whether a text parses.
"""

from __future__ import annotations

from functools import lru_cache

from .engine import Grammar
from .lexers import symbols


def _go() -> Grammar:
    body = """
first = 'package' 'id' end
rest = ';' | 'import' < P.imports | impspec > end | decl end
end = 'nl' | ';' | !.
imports = < impspec end >?
impspec = < 'id' | '.' >? 'str'
decl = func | spec
spec = 'var' < P.varspecs | varspec > | 'const' < P.constspecs | constspec > | 'type' < P.typespecs | typespec >
varspecs = < varspec end >*
constspecs = < constspec end >*
typespecs = < typespec end >*
ids = 'id' < ',' 'id' >*
varspec = ids < type < '=' exprs >? | '=' exprs >
constspec = ids < type? '=' exprs >?
typespec = 'id' < S.tparams !< end > type | '='? type >
func = 'func' P.params? 'id' S.tparams? P.params result? B.block?
result = P.params | type
type = '*' type | S.arrlen type | 'map' S.typ type | 'chan' '<-'? type | '<-' 'chan' type | 'func' P.params result? | 'struct' B.fields | 'interface' B.iface | P.typ | 'id' < '.' 'id' >? S.types?
typ = type
types = type < ',' type >* ','?
arrlen = < '...' | expr >?
tparams = ids union < ',' ids union >* ','?
union = '~'? type < '|' '~'? type >*
params = < param < ',' param >* ','? >?
param = 'id' '...'? type | '...' type | type
fields = < < ids type | '*'? 'id' < '.' 'id' >? S.types? > 'str'? >? end
iface = < 'id' P.params result? | union >? end
block = stmts
stmts = stmt? < ';' stmt? >* 'nl'?
stmt = 'id' ':' stmt? | 'return' exprs? | if | 'for' forhdr? B.block | 'switch' swhdr? B.cases | 'select' B.comm | 'defer' expr | 'go' expr
  | 'break' 'id'? | 'continue' 'id'? | 'goto' 'id' | 'fallthrough' | spec | B.block | simple
simple = exprs < < ':=' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' > exprs | '++' | '--' | '<-' expr >?
hsimple = hexprs < < ':=' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' > hexprs | '++' | '--' | '<-' hexpr >?
if = 'if' < hsimple? ';' >? hexpr B.block < 'else' < if | B.block > >?
forhdr = hexprs < ':=' | '=' > 'range' hexpr | 'range' hexpr | hsimple? ';' hexpr? ';' hsimple? | hexpr
swhdr = hsimple? ';' hsimple? | hsimple
cases = < < 'case' exprs | 'default' > ':' >* stmts
comm = < < 'case' simple | 'default' > ':' >* stmts
exprs = expr < ',' expr >*
hexprs = hexpr < ',' hexpr >*
expr = unary < binop unary >*
hexpr = hunary < binop hunary >*
binop = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'
unary = < '+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~' >* operand postfix*
hunary = < '+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~' >* hoperand hpostfix*
hoperand = 'num' | 'str' | 'chr' | 'func' P.params result? B.block | 'id' | S.arrlen type B.lit? | 'map' S.typ type B.lit? | 'struct' B.fields | 'interface' B.iface | 'chan' type | P.paren
operand = 'struct' B.fields B.lit? | 'func' P.params result? !B.block | 'id' B.lit | hoperand
paren = expr | type
hpostfix = '.' 'id' | '.' P.assert | S.index | P.args
postfix = '.' 'id' B.lit? | '.' P.assert | S.index B.lit? | P.args
assert = 'type' | type
index = < expr? ':' expr? < ':' expr >? | types ','? | exprs ','? >
args = < arg < ',' arg >* '...'? ','? >?
arg = expr | type
lit = < elem < ',' elem >* ','? >?
elem = < expr | B.lit > < ':' < expr | B.lit > >?
"""
    return Grammar(body, "rest", "first")


_SCRIPT = """
stmts = stmt*
end = ';' | 'nl' | !.
ident = 'id' | 'async' | 'get' | 'set' | 'of' | 'from' | 'as' | 'static' | 'let' @IDS
word = ident | 'priv' | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'export' | 'extends' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof'
  | 'new' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' | 'yield' | 'null' | 'true' | 'false' | 'enum' | 'await'
top = topstmt*
topstmt = import | export | stmt
stmt = ';' | 'nl' | B.stmts | if | 'for' 'await'? P.forhdr 'nl'? stmt | 'while' P.exprs 'nl'? stmt | 'do' stmt 'nl'? 'while' P.exprs < ';' | 'nl' >? | 'switch' P.exprs B.cases
  | 'try' B.stmts < 'nl'? 'catch' P.param1? B.stmts < 'nl'? 'finally' B.stmts >? | 'nl'? 'finally' B.stmts > | 'return' exprs? end | 'break' ident? end | 'continue' ident? end | 'throw' exprs end | 'debugger' end
  | vars end | func | class | @TSDECL ident ':' stmt | !< 'function' | 'class' | 'let' S.stmts > exprs end
if = 'if' P.exprs 'nl'? stmt < 'nl'? 'else' 'nl'? stmt >?
forhdr = vars0? ';' exprs? ';' exprs? | exprs ';' exprs? ';' exprs? | < 'var' | 'let' | 'const' > bind0 < 'of' assign | 'in' exprs > | postfix < 'of' assign | 'in' exprs >
vars0 = < 'var' | 'let' | 'const' > bind < ',' bind >*
vars = < 'var' | 'let' | 'const' > bind < ',' bind >*
bind = bind0 @ANN < '=' assign >?
bind0 = ident | B.obj | S.arr
cases = < 'case' exprs ':' | 'default' ':' | stmt >*
import = 'import' < 'str' | @TYPEKW imports 'from' 'str' > < 'with' B.obj >? end
imports = ident < ',' < B.names | '*' 'as' ident > >? | B.names | '*' 'as' ident
names = < name < ',' name >* ','? >?
name = @TYPEKW < word | 'str' > < 'as' < word | 'str' > >?
export = 'export' < 'default' < func | class | @DEFDECL assign end > | '*' < 'as' < word | 'str' > >? 'from' 'str' end | @TYPEKW B.names < 'from' 'str' >? end | vars end | func | class | @EXPDECL !. . >
func = 'async'? 'function' '*'? ident? @TPARAMS P.params @RET @BODY
params = < param < ',' param >* ','? >?
param = @PMODS '...'? < ident | B.obj | S.arr @THIS > @QM @ANN < '=' assign >?
param1 = bind0 @ANN
class = @DECOS 'class' < !< 'extends' @IMPL0 > ident >? @TPARAMS < 'extends' lhs @TARGS >? @IMPL B.cls
lhs = primary < '.' word | S.exprs | P.args >*
cls = member*
member = ';' | 'nl' | 'static' B.stmts | @DECOS < mod &< word | 'str' | 'num' | S.exprs | '*' | '[' | B.stmts > >* '*'? key @QX < @TPARAMS P.params @RET < B.stmts @SIGEND > | @ANN < '=' assign >? end > @IDXMEM
mod = 'static' | 'get' | 'set' | 'async' @MODS
key = word | 'str' | 'num' | S.exprs
exprs = assign < ',' assign >*
args = < arg < ',' arg >* ','? >?
arg = '...'? assign
assign = arrow | 'yield' < '*'? assign >? | cond < asgop assign >?
asgop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '**=' | '&&=' | '||=' | '??=' | '>' '>=' | '>' '>' '>='
arrow = 'async'? @TPARAMS < ident | P.params @RET > '=>' < B.stmts | assign >
cond = bin < '?' assign ':' assign >?
bin = < 'priv' 'in' >? unary < binop unary @ASTYPE >*
binop = '||' | '&&' | '??' | '==' | '!=' | '===' | '!==' | '<' | '<=' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '&' | '**' | 'in' | 'instanceof' | '>' '>' '>' | '>' '>' | '>' '>=' | '>'
unary = < '+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new' | @CAST >* postfix @ASTYPE
postfix = primary < '.' word | '?.' < word | S.exprs | P.args | @TARGS1 P.args > | S.exprs | P.args | 'str' @NONNULL >* < '++' | '--' >?
primary = 'num' | 'str' | 'regex' | 'this' | 'super' | 'null' | 'true' | 'false' | 'async' 'function' '*'? ident? @TPARAMS P.params @RET B.stmts | 'function' '*'? ident? @TPARAMS P.params @RET B.stmts
  | class | 'import' < P.args | '.' word > | '.' word | P.exprs | S.arr | B.obj | ident
arr = < ',' | '...'? assign &< ',' | !. > >*
obj = < prop < ',' prop >* ','? >?
prop = '...' assign | key ':' assign | < < 'get' | 'set' | 'async' > &< word | 'str' | 'num' | S.exprs | '*' > >? '*'? key @TPARAMS P.params @RET B.stmts | ident < '=' assign >?
"""

_TYPES = """
type = 'asserts' < ident | 'this' > < 'is' type >? | < ident | 'this' > 'is' type | fntype | utype < 'extends' utype '?' type ':' type >?
fntype = < 'abstract'? 'new' >? tparams? P.params '=>' type
utype = < '|' | '&' >? ttype < < '|' | '&' > ttype >*
ttype = < 'keyof' | 'typeof' | 'readonly' | 'unique' | 'infer' >* tprim < !< 'nl' > S.tidx >*
tidx = type?
tprim = fntype | P.type | B.tmembers | S.tuple | 'str' | '-'? 'num' | 'null' | 'this' | 'void' | 'true' | 'false' | 'import' P.args < '.' word >* targs? | ident < '.' word >* targs?
tuple = < telem < ',' telem >* ','? >?
telem = '...'? < ident '?'? ':' >? type '?'?
targs = '<' type < ',' type >* ','? '>'
tparams = '<' tparam < ',' tparam >* ','? '>'
tparam = < 'const' | 'in' | 'out' >* ident < 'extends' type >? < '=' type >?
tmembers = tmember*
tmember = ';' | 'nl' | ',' | < < 'readonly' | 'get' | 'set' > &< word | 'str' | 'num' | S.tkey > >* < 'new'? tparams? P.params < ':' type >? | < '+' | '-' >? 'readonly'? < word | 'str' | 'num' | S.tkey > < '?' | '-' '?' | '+' '?' >? < tparams? P.params < ':' type >? | < ':' type >? > > < ';' | 'nl' | ',' | !. >
tkey = ident ':' type | ident 'in' type < 'as' type >? | exprs
ann = ':' type
tsdecl = 'interface' ident tparams? < 'extends' type < ',' type >* >? B.tmembers | 'type' ident tparams? '=' type end | 'const'? 'enum' ident B.enum | 'declare' < tsdecl | 'nl'? vars end | func | class | 'global' B.top >
  | < 'namespace' | 'module' > < ident < '.' ident >* | 'str' > < B.top | end > | 'abstract' class
enum = < emember < ',' emember >* ','? >?
emember = < word | 'str' | S.exprs > < '=' assign >?
deco = '@' < P.exprs | ident < '.' word >* < targs? P.args >? > 'nl'?
"""

_JS_PARTS = {
    "@IDS": "", "@TSDECL": "", "@ANN": "", "@TYPEKW": "", "@DEFDECL": "", "@EXPDECL": "", "@TPARAMS": "", "@RET": "", "@BODY": "B.stmts", "@PMODS": "", "@THIS": "", "@QM": "", "@QX": "",
    "@DECOS": "", "@IMPL0": "ident", "@IMPL": "", "@TARGS1": "!. .", "@TARGS": "", "@SIGEND": "", "@IDXMEM": "", "@MODS": "", "@ASTYPE": "", "@CAST": "'new'", "@NONNULL": "",
}
_TS_PARTS = {
    "@IDS": "| 'type' | 'interface' | 'namespace' | 'module' | 'declare' | 'abstract' | 'readonly' | 'public' | 'private' | 'protected' | 'implements' | 'is' | 'keyof' | 'infer' | 'unique' | 'asserts' | 'satisfies' | 'override' | 'accessor' | 'global'",
    "@TSDECL": "tsdecl |", "@ANN": "'!'? ann?", "@TYPEKW": "< 'type' &< ident | B.names | '*' > !< 'from' 'str' > >?", "@DEFDECL": "tsdecl |", "@EXPDECL": "tsdecl | '=' exprs end | 'as' 'namespace' ident end | 'import' ident '=' exprs end |",
    "@TPARAMS": "tparams?", "@RET": "< ':' type >?", "@BODY": "< B.stmts | end >", "@PMODS": "deco* < < 'public' | 'private' | 'protected' | 'readonly' | 'override' > &< word | B.obj | S.arr > >*", "@THIS": "| 'this'", "@QM": "'?'?", "@QX": "< '?' | '!' >?",
    "@DECOS": "deco* 'abstract'?", "@IMPL0": "lhs targs? < 'implements' | B.cls >", "@IMPL": "< 'implements' type < ',' type >* >?", "@TARGS1": "targs", "@TARGS": "targs?", "@SIGEND": "| end",
    "@IDXMEM": "| mod* S.tkey ':' type end", "@MODS": "| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor'",
    "@ASTYPE": "< 'as' < 'const' | type > | 'satisfies' type >*", "@CAST": "targs", "@NONNULL": "| '!' | targs &< P.args | 'str' | ')' | ',' | ';' | 'nl' | !. >",
}


def _script(parts: dict[str, str], more: str = "") -> Grammar:
    text = _SCRIPT
    for k in sorted(parts, key=len, reverse=True):
        text = text.replace(k, parts[k])
    return Grammar(text + more, "top")


def _java() -> Grammar:
    return Grammar(
        """
ident = 'id' | 'record' | 'sealed' | 'permits' | 'yield' | 'var' | 'module' | 'open' | 'non'
qname = ident < '.' ident >*
file = < ';' | annos 'package' qname ';' | 'import' 'static'? qname < '.' '*' >? ';' | mods typedecl >*
annos = anno*
anno = '@' !< 'interface' > qname P.annoargs?
annoargs = < elpair < ',' elpair >* >?
elpair = ident '=' elval | elval
elval = anno | B.elvals | cond
elvals = < elval < ',' elval >* ','? >?
mods = < anno | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' &< modnext > | 'non' '-' 'sealed' >*
modnext = 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'class' | 'interface'
typedecl = 'class' ident tparams? < 'extends' type >? < 'implements' types >? < 'permits' types >? B.cls | 'interface' ident tparams? < 'extends' types >? < 'permits' types >? B.cls
  | 'enum' ident < 'implements' types >? B.enum | 'record' ident tparams? P.params < 'implements' types >? B.cls | '@' 'interface' ident B.cls
types = type < ',' type >*
type = annos < prim | ident targs? < '.' annos ident targs? >* > < annos S.empty >*
prim = 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double'
empty = !.
targs = '<' < targ < ',' targ >* >? '>'
targ = annos '?' < < 'extends' | 'super' > type >? | type
tparams = '<' tparam < ',' tparam >* '>'
tparam = annos ident < 'extends' type < '&' type >* >?
cls = member*
enum = < econst < ',' econst >* >? ','? < ';' cls >? !. | cls
econst = annos ident P.args? B.cls?
member = ';' | 'static'? B.block | mods < typedecl | tparams? ident P.params throws? B.block | ident B.block | tparams? < type | 'void' > ident < P.params dims throws? < B.block | 'default' elval ';' | ';' > | vardims < ',' ident vardims >* ';' > >
throws = 'throws' types
dims = S.empty*
vardims = dims < '=' varinit >?
varinit = B.arrinit | expr
arrinit = < varinit < ',' varinit >* >? ','?
params = < param < ',' param >* >?
param = mods type annos '...'? < ident '.' >* < ident | 'this' > dims
block = bstmt*
bstmt = localclass | local ';' | stmt
localclass = mods < 'class' | 'interface' | 'enum' | 'record' ident < tparams | P.params > | '@' 'interface' > !. . | mods &< 'class' | 'interface' | 'enum' | 'record' ident < '<' | P.params > > typedecl
local = mods type ident vardims < ',' ident vardims >*
stmt = ';' | B.block | 'if' P.expr stmt < 'else' stmt >? | 'while' P.expr stmt | 'do' stmt 'while' P.expr ';' | 'for' P.forhdr stmt | 'switch' P.expr B.switch | 'return' expr? ';' | 'break' ident? ';' | 'continue' ident? ';'
  | 'throw' expr ';' | 'synchronized' P.expr B.block | 'try' P.resources? B.block < 'catch' P.catch B.block >* < 'finally' B.block >? | 'assert' expr < ':' expr >? ';' | 'yield' !< asgop | '.' | '++' | '--' > expr ';' | ident ':' stmt | exprstmt ';'
exprstmt = '++' unary | '--' unary | lhsexpr
lhsexpr = postfix < asgop expr >?
catch = mods type < '|' type >* ident
resources = < < local | qname > < ';' < local | qname > >* ';'? >
forhdr = mods type ident dims ':' expr | < local | exprstmt < ',' exprstmt >* >? ';' expr? ';' < exprstmt < ',' exprstmt >* >?
switch = < < 'case' labels | 'default' > < ':' | '->' < B.block | 'throw' expr ';' | expr ';' > > | bstmt >*
labels = label < ',' label >*
label = 'default' | mods type ident &< '->' | ':' | ',' | '&&' > < '&&' expr >? | cond
expr = lambda | cond < asgop expr >?
asgop = '=' | '+=' | '-=' | '*=' | '/=' | '&=' | '|=' | '^=' | '%=' | '<<=' | '>' '>=' | '>' '>' '>=' | '>>=' | '>>>='
lambda = < ident | P.lparams > '->' < B.block | expr >
lparams = < ident < ',' ident >* !. | params >
cond = bin < '?' < lambda | expr > ':' < lambda | cond > >?
bin = unary < binop unary | 'instanceof' 'final'? type ident? >*
binop = '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<=' | '>=' | '<<' | '>' '>' '>' | '>' '>' | '>' '>=' | '<' | '>' | '+' | '-' | '*' | '/' | '%'
unary = '++' unary | '--' unary | '+' unary | '-' unary | '!' unary | '~' unary | P.prim unary | P.cast < lambda | castable > | 'switch' P.expr B.switch | postfix
prim1 = prim S.empty*
cast = type < '&' type >*
castable = &< ident | 'num' | 'str' | 'chr' | 'this' | 'super' | 'new' | 'true' | 'false' | 'null' | P.expr | '!' | '~' | prim | 'void' | 'switch' > unary
postfix = primary < '.' < targs? < ident | 'this' | 'class' | 'super' | 'new' creator > > | S.expr | P.args | '::' targs? < ident | 'new' > >* < '++' | '--' >*
primary = 'num' | 'str' | 'chr' | 'true' | 'false' | 'null' | 'this' | 'super' | 'void' '.' 'class' | 'new' creator | prim S.empty* < '.' 'class' | '::' 'new' > | ident targs? S.empty < S.empty >* < '.' 'class' | '::' 'new' > | ident < '.' ident >* targs S.empty* '::' < ident | 'new' >
  | ident < '.' ident >+ S.empty+ < '.' 'class' | '::' 'new' > | P.expr | ident
creator = annos < prim | ident targs? < '.' ident targs? >* > < P.args B.cls? | S.empty+ B.arrinit | S.expr < S.expr | S.empty >* >
args = < expr < ',' expr >* >?
""".replace("P.prim unary", "P.prim1 unary"),
        "file",
    )


def _rust() -> Grammar:
    body = """
ident = 'id' | 'union' | 'macro_rules' | 'default' | 'auto'
file = item*
iattr = '#' '!' S.any
attr = '#' S.any
any = anytok*
anytok = P.any | S.any | B.any | !< ')' | ']' | '}' > .
vis = 'pub' P.vispath?
vispath = 'in'? path
item = iattr | ';' | attr* vis? < 'use' usetree ';' | 'mod' ident < ';' | B.file > | 'extern' 'crate' < ident | 'self' > < 'as' ident >? ';' | fn | 'type' ident gparams? < ':' bounds >? where? < '=' type >? where? ';'
  | 'struct' ident gparams? < where? B.fields | P.tfields where? ';' | ';' > | 'union' ident gparams? where? B.fields | 'enum' ident gparams? where? B.variants | < 'const' | 'static' > 'mut'? < ident | '_' > ':' type < '=' expr >? ';'
  | 'unsafe'? 'auto'? 'trait' ident gparams? < ':' bounds? >? where? B.assoc | 'default'? 'unsafe'? 'impl' < gparams &< type | '!' > >? 'const'? '!'? type < 'for' type >? where? B.assoc | 'unsafe'? 'extern' 'str'? B.assoc
  | 'macro_rules' '!' ident < B.any | P.any ';' | S.any ';' > | path '!' ident? < B.any | P.any ';' | S.any ';' > >
assoc = item*
fn = < 'default' | 'const' | 'async' | 'unsafe' | 'extern' 'str'? >* 'fn' ident gparams? P.params < '->' type >? where? < B.block | ';' >
usetree = < '::' >? < '*' | B.uses | pseg < '::' < '*' | B.uses | pseg > >* > < 'as' < ident > >?
uses = < usetree < ',' usetree >* ','? >?
pseg = ident | 'self' | 'super' | 'crate' | 'Self'
fields = < field < ',' field >* ','? >?
field = attr* vis? ident ':' type
tfields = < attr* vis? type < ',' attr* vis? type >* ','? >?
variants = < variant < ',' variant >* ','? >?
variant = attr* vis? ident < B.fields | P.tfields >? < '=' expr >?
gparams = '<' < gparam < ',' gparam >* ','? >? '>'
gparam = attr* < 'life' < ':' < 'life' < '+' 'life' >* >? >? | 'const' ident ':' type < '=' expr1 >? | ident < ':' bounds? >? < '=' type >? >
bounds = bound < '+' bound >* '+'?
bound = 'life' | P.bound1 | < '?' | '~' 'const' >? hrtb? tpath
bound1 = '?'? hrtb? tpath
hrtb = 'for' gparams
where = 'where' < wpred < ',' wpred >* ','? >?
wpred = 'life' ':' bounds? | hrtb? type ':' bounds?
params = < fparam < ',' fparam >* ','? >?
fparam = attr* < < '&' 'life'? >? 'mut'? 'self' < ':' type >? | '...' | pat ':' type | type >
type = type1 < '+' bound >*
type1 = '&' 'life'? 'mut'? type1 | '&&' 'life'? 'mut'? type1 | '*' < 'const' | 'mut' > type1 | S.arrtype | P.tuptype | '!' | '_' | < 'dyn' | 'impl' > bounds | hrtb? < 'unsafe' | 'extern' 'str'? >* 'fn' P.fnparams < '->' type1 >? | hrtb? tpath < '!' < P.any | S.any | B.any > >?
arrtype = type < ';' expr >?
tuptype = < type < ',' type >* ','? >?
fnparams = < fnp < ',' fnp >* ','? >?
fnp = attr* < '...' | < < ident | '_' > ':' >? type >
tpath = < qself '::' tseg | '::'? tseg > < '::' tseg >*
qself = '<' type < 'as' type >? '>'
tseg = pseg < '::'? gargs | P.fnparams < '->' type1 >? >?
gargs = '<' < garg < ',' garg >* ','? >? '>'
garg = 'life' | ident gargs? '=' type | ident gargs? ':' bounds | type | B.block | '-'? 'num' | 'str' | 'true' | 'false' | 'chr'
path = < '::' >? pseg < '::' pseg >*
block = iattr* bstmt*
bstmt = ';' | attr* < 'let' pat < ':' type >? < '=' expr < 'else' B.block >? >? ';' | !< 'union' !< ident > | 'unsafe' B.block | 'const' B.block | 'async' 'move'? B.block | 'default' !< 'fn' | 'impl' > | 'auto' > item0 | blockexpr !< '.' | '?' > | expr < ';' | !. > >
item0 = !< path '!' < P.any | S.any | B.any > > item
blockexpr = < 'life' ':' >? < if | match | 'unsafe' B.block | 'loop' B.block | 'while' cond B.block | 'for' pat 'in' hexpr B.block | B.block | 'const' B.block | 'async' 'move'? B.block | path '!' B.any >
if = 'if' cond B.block < 'else' < if | B.block > >?
match = 'match' hexpr B.arms
cond = condpart < < '&&' > condpart >*
condpart = 'let' pat '=' hexprlet | hexpr
arms = iattr* arm*
arm = attr* pat < 'if' < cond | expr > >? '=>' < blockexpr !< '.' | '?' | binop > ','? | expr < ',' | !. > >
pat = '|'? pat1 < '|' pat1 >*
pat1 = pat0 < < '..=' | '...' | '..' > patlit? >? | < '..=' | '..' > patlit?
patlit = '-'? 'num' | 'chr' | 'str' | < qself '::' pseg | path > < '::' pseg >*
pat0 = '&' 'mut'? pat0 | '&&' 'mut'? pat0 | 'ref' 'mut'? ident < '@' pat1 >? | 'mut' ident < '@' pat1 >? | '_' | '-' 'num' | 'num' | 'str' | 'chr' | 'true' | 'false' | P.pats | S.pats | 'box' pat0
  | < qself < '::' tseg >+ | '::'? patseg < '::' patseg >* > < P.pats | B.fpats | '!' < P.any | S.any | B.any > | '@' pat1 >?
patseg = pseg < '::' gargs >?
pats = < attr* pat < ',' attr* pat >* ','? >?
fpats = < fpat < ',' fpat >* ','? >?
fpat = attr* < '..' | < ident | 'num' > ':' pat | 'ref'? 'mut'? ident >
binop = '||' | '&&' | '==' | '!=' | '<=' | '>=' | '<<' | '>' '>' | '<' | '>' | '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^'
asgop = '=' | '+=' | '-=' | '*=' | '/=' | '&=' | '|=' | '^=' | '%=' | '<<=' | '>' '>=' | '>>='
@EXPR
args = < attr* expr < ',' attr* expr >* ','? >?
arr = < attr* expr < ';' expr | < ',' attr* expr >* ','? > >?
expr1 = B.block | '-'? 'num' | 'str' | 'chr' | 'true' | 'false' | path
finit = < attr* fi < ',' attr* fi >* ','? >?
fi = '..' expr? | < ident | 'num' > < ':' expr >?
index = expr
cparams = < cparam < ',' cparam >* ','? >?
cparam = attr* pat1 < ':' type >?
"""
    rules = """
{h}expr = 'return' {h}expr? | 'break' 'life'? {h}expr? | 'continue' 'life'? | {h}closure | {h}range < asgop {h}expr >?
{h}closure = < 'for' gparams >? 'static'? 'async'? 'move'? < '||' | '|' cparams '|' > < '->' type1 B.block | {h}expr >
{h}range = < '..' | '..=' > {h}bin? | {h}bin < '..=' {h}bin | '..' {h}bin? >?
{h}bin = {h}unary < binop {h}unary >*
{h}unary = < '-' | '!' | '*' | '&' 'raw' < 'const' | 'mut' > | '&' 'mut'? | '&&' 'mut'? >* < {h}closure | 'return' {h}expr? | 'break' 'life'? {h}expr? | 'continue' 'life'? | {h}postfix >
{h}postfix = {h}primary < '.' 'await' | '.' < ident | 'num' | 'self' > < '::' gargs >? | P.args | S.index | '?' >* < 'as' type1 >*
{h}primary = 'num' | 'str' | 'chr' | 'true' | 'false' | '_' | blockexpr | P.args | S.arr | {h}pathexpr
{h}pathexpr = < qself < '::' tsegx >+ | '::'? tsegx < '::' < tsegx | gargs > >* > < '!' < P.any | S.any | B.any > {lit} >?
"""
    text = rules.format(h="", lit="| B.finit") + rules.format(h="h", lit="").replace("{lit}", "") + "hexprlet = hlrange\nhlrange = hlbin < < '..=' | '..' > hlbin? >?\nhlbin = hunary < !< '&&' | '||' > binop hunary >*\ntsegx = pseg\n"
    return Grammar(body.replace("@EXPR", text), "file")


def _c() -> Grammar:
    return Grammar(
        """
file = extdecl*
attrs = < '__attribute__' P.any | < 'asm' | '__asm__' > 'volatile'? P.any | '__extension__' >*
any = anytok*
anytok = P.any | S.any | B.any | !< ')' | ']' | '}' > .
extdecl = ';' | < 'asm' | '__asm__' > P.any ';' | sassert | attrs specs attrs declr attrs olddecl* B.block | attrs declr0 B.block | decl | 'id' P.any ';'?
olddecl = specs declr < ',' declr >* ';'
declr0 = 'id' P.params
sassert = '_Static_assert' P.args ';'
decl = attrs specs < initdeclr < ',' initdeclr >* >? attrs ';'
initdeclr = attrs declr attrs < '=' init >?
init = B.inits | assign
inits = < dinit < ',' dinit >* ','? >?
dinit = < < S.constr | '.' 'id' >+ '=' | 'id' ':' >? init
constr = cond < '...' cond >?
storage = 'typedef' | 'extern' | 'static' | '_Thread_local' | 'auto' | 'register' | 'inline' | '__inline' | '__inline__' | '_Noreturn' | 'const' | 'restrict' | '__restrict' | 'volatile' | '_Atomic' !P.any | '_Alignas' P.any | '__attribute__' P.any | '__extension__'
prim = 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Complex'
specs = storage* < < prim storage* >+ | 'id' storage* | < 'struct' | 'union' > attrs < 'id' B.fields? | B.fields > storage* | 'enum' attrs < 'id' B.enums? | B.enums > storage* | < 'typeof' | '__typeof__' > P.any storage* | '_Atomic' P.typename storage* >
fields = field*
field = ';' | sassert | attrs specs < fdeclr < ',' fdeclr >* >? attrs ';'
fdeclr = declr? ':' cond attrs | declr attrs
enums = < 'id' attrs < '=' cond >? < ',' 'id' attrs < '=' cond >? >* ','? >
quals = < 'const' | 'restrict' | '__restrict' | 'volatile' | '_Atomic' | '__attribute__' P.any >*
declr = < '*' quals >* attrs < 'id' | P.declr > < P.params | S.arrdim >*
absdeclr = < '*' quals >* < 'id' | P.absdeclr1 >? < P.params | S.arrdim >*
absdeclr1 = < '*' quals >+ attrs < 'id' | P.absdeclr1 >? < P.params | S.arrdim >* | < 'id' | P.absdeclr1 > < P.params | S.arrdim >* | < S.arrdim >+
arrdim = < 'static' | 'const' | 'restrict' | '__restrict' | 'volatile' >* < '*' !. | assign >?
params = < param < ',' param >* < ',' '...' >? >?
param = attrs specs absdeclr attrs
typename = specs absdeclr
block = bstmt*
bstmt = sassert | 'id' ':' | 'case' constr ':' | 'default' ':' | stmt !< B.block > | decl | nested
nested = specs declr B.block
stmt = ';' | B.block | 'if' P.exprs lstmt < 'else' lstmt >? | 'switch' P.exprs lstmt | 'while' P.exprs lstmt | 'do' lstmt 'while' P.exprs ';' | 'for' P.forhdr lstmt | 'goto' < 'id' | '*' cond > ';' | 'continue' ';' | 'break' ';' | 'return' exprs? ';'
  | < 'asm' | '__asm__' > < 'volatile' | 'goto' | 'inline' >* P.any ';' | !< specs < '*' quals >+ 'id' < '=' | ';' | ',' | S.arrdim > > exprs ';'
lstmt = < 'id' ':' | 'case' constr ':' | 'default' ':' >* stmt
forhdr = < fordecl | exprs? ';' > exprs? ';' exprs?
fordecl = specs initdeclr < ',' initdeclr >* ';'
exprs = assign < ',' assign >*
assign = cond < < '=' | '+=' | '-=' | '*=' | '/=' | '&=' | '|=' | '^=' | '%=' | '<<=' | '>>=' > assign >?
cond = bin < '?' exprs? ':' cond >?
bin = unary < < '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '+' | '-' | '*' | '/' | '%' > unary >*
unary = < '++' | '--' | '&' | '&&' | '*' | '+' | '-' | '~' | '!' | '__extension__' | P.typename &< 'num' | 'str' | 'chr' | 'id' | '~' | '!' | 'sizeof' | P.exprs > !< B.inits > >* < < 'sizeof' | '_Alignof' > < P.typename !B.inits | P.exprs postop* | unary > | P.typename B.inits postop* | primary postop* | P.typename unary >
postop = S.exprs | P.args | '.' 'id' | '->' 'id' | '++' | '--'
primary = 'id' 'str'? 'id'? | 'num' | 'chr' | < 'str' 'id'? >+ | '_Generic' P.any | '__builtin_va_arg' P.any | P.stmtexpr
stmtexpr = B.block | exprs
args = < arg < ',' arg >* >?
arg = assign | typename
""",
        "file",
    )


def _python() -> Grammar:
    return Grammar(
        """
ident = 'id' | 'match' | 'case' | 'type'
file = line*
block = line*
line = 'nl' | compound | simple < ';' simple >* ';'? 'nl'
body = I.block1 | simple < ';' simple >* ';'? 'nl'
block1 = line+
simple = 'pass' | 'break' | 'continue' | 'return' star? | 'raise' < expr < 'from' expr >? >? | 'global' ident < ',' ident >* | 'nonlocal' ident < ',' ident >* | 'del' targets | 'assert' expr < ',' expr >? | 'import' dotas < ',' dotas >* | 'from' from
  | 'type' ident S.any? '=' expr | assign
from = < '.' | '...' >* dotted? 'import' < '*' | P.names | asname < ',' asname >* >
names = asname < ',' asname >* ','?
asname = ident < 'as' ident >?
dotas = dotted < 'as' ident >?
dotted = ident < '.' ident >*
targets = starx < ',' starx >* ','?
assign = 'yield' < 'from' expr | star >? | star < ':' expr < '=' rhs >? | < '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' > rhs | < '=' rhs >* >
rhs = 'yield' < 'from' expr | star >? | star
star = starx < ',' starx >* ','?
starx = '*' bin | named
compound = 'if' named ':' body < 'elif' named ':' body >* < 'else' ':' body >? | 'while' named ':' body < 'else' ':' body >? | 'async'? 'for' ftargets 'in' star ':' body < 'else' ':' body >?
  | 'try' ':' body < < 'except' '*'? < exprs < 'as' ident >? >? ':' body >+ < 'else' ':' body >? < 'finally' ':' body >? | 'finally' ':' body > | 'async'? 'with' < P.withitems ':' | witem < ',' witem >* ':' > body
  | decos < 'async'? 'def' ident S.any? P.params < '->' exprs >? ':' body | 'class' ident S.any? P.args? ':' body > | 'match' star ':' I.cases
cases = < 'case' pattern < 'if' named >? ':' body >+
pattern = patt < ',' patt >* ','?
patt = < '*' ident | por > < 'as' ident >?
por = pprim < '|' pprim >*
pprim = '-'? 'num' < < '+' | '-' > 'num' >? | 'str'+ | 'None' | 'True' | 'False' | P.any | S.any | B.any | dotted P.any?
decos = < '@' named 'nl' >*
withitems = < witem < ',' witem >* ','? >
witem = expr < 'as' starx >?
ftargets = ft < ',' ft >* ','?
ft = '*'? postfix
exprs = expr < ',' expr >*
named = ident ':=' expr | expr
expr = 'lambda' lparams ':' expr | or < 'if' or 'else' expr >?
lparams = < lparam < ',' lparam >* ','? >?
lparam = '/' | < '*' | '**' >? ident < '=' expr >? | '*'
or = not < < 'and' | 'or' > not >*
not = 'not'* cmp
cmp = bin < < '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not' | 'is' > bin >*
bin = unary < < '+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>' | '**' > unary >*
unary = < '+' | '-' | '~' | 'await' >* postfix
postfix = primary < '.' ident | P.args | S.index >*
primary = 'num' | 'str'+ | 'None' | 'True' | 'False' | '...' | ident | P.paren | S.list | B.dict
comp = < 'async'? 'for' ftargets 'in' or < 'if' named0 >* >+
named0 = ident ':=' expr | or | 'lambda' lparams ':' expr
paren = < 'yield' < 'from' expr | star >? | starx comp | star >?
list = < starx comp | star >?
index = < slice < ',' slice >* ','? >
slice = < named? ':' expr? < ':' expr? >? > | starx
dict = < kv comp | kv < ',' kv >* ','? | starx comp | star >?
kv = '**' bin | expr ':' expr
args = < arg comp | arg < ',' arg >* ','? >?
arg = '**' expr | '*' expr | ident '=' expr | named
params = < fparam < ',' fparam >* ','? >?
fparam = '/' | < '*' | '**' >? ident < ':' starx >? < '=' expr >? | '*'
any = anytok*
anytok = P.any | S.any | B.any | !< ')' | ']' | '}' > .
""",
        "file",
    )


_BUILD = {"go": _go, "javascript": lambda: _script(_JS_PARTS), "typescript": lambda: _script(_TS_PARTS, _TYPES), "java": _java, "rust": _rust, "c": _c, "python": _python}
LANGUAGES = tuple(_BUILD)


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    g = _BUILD[language]()
    g.tokens = symbols(language)
    return g
