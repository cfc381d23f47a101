"""Grammars for the derivative parser: Java 17, ECMAScript 2022, TypeScript 5, Python 3.12 and SQL.

They hold what the language references say about tokens in sequence, and are a little wider in
places where only later passes of a compiler would object. ID, NUM, STR, TEMPLATE, REGEX, NEWLINE,
INDENT and DEDENT are token classes, other quoted words stand for themselves.
"""

JAVA = r"""
unit = (annot* 'package' qname ';')? (import | ';')* (typedecl | module)*
module = annot* 'open'? 'module' qname '{' ((ident | 'transitive' | 'static' | 'with' | 'to' | ',' | '.' | ';'))* '}'
import = 'import' 'static'? qname ('.' '*')? ';'
ident = ID | 'record' | 'var' | 'yield' | 'sealed' | 'permits' | 'module' | 'open' | 'with' | 'to' | 'when' | 'transitive'
qname = ident ('.' ident)*
typedecl = ';' | mods (class | iface | enum | record | annotype)
modifier = 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non-sealed'
mods = (modifier | annot)*
annot = '@' qname ('(' (annval | ident '=' annval (',' ident '=' annval)*)? ')')?
annval = ternary | annot | '{' (annval (',' annval)*)? ','? '}'
class = 'class' ident tparams? ('extends' type)? ('implements' types)? ('permits' types)? classbody
iface = 'interface' ident tparams? ('extends' types)? ('permits' types)? classbody
enum = 'enum' ident ('implements' types)? '{' (enumconst (',' enumconst)*)? ','? (';' member*)? '}'
enumconst = annot* ident ('(' args? ')')? classbody?
record = 'record' ident tparams? '(' (param (',' param)*)? ')' ('implements' types)? classbody
annotype = '@' 'interface' ident classbody
classbody = '{' member* '}'
member = ';' | 'static'? block | mods (class | iface | enum | record | annotype | tparams? type ident (methodrest | fieldrest) | tparams? ident (methodrest | block))
methodrest = '(' params? ')' dims throws? (block | ';' | 'default' annval ';')
fieldrest = dims ('=' varinit)? (',' ident dims ('=' varinit)?)* ';'
throws = 'throws' types
params = param (',' param)*
param = mods type (annot* '...')? (ident | ident? 'this') dims
types = type (',' type)*
prim = 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' | 'void'
type = annot* (prim | ident targs? ('.' annot* ident targs?)*) dims
dims = (annot* '[' ']')*
targs = '<' (targ (',' targ)*)? '>'
targ = annot* '?' (('extends' | 'super') type)? | type
tparams = '<' tparam (',' tparam)* '>'
tparam = annot* ident ('extends' type ('&' type)*)?
varinit = expr | arrayinit
arrayinit = '{' (varinit (',' varinit)*)? ','? '}'
block = '{' stmt* '}'
stmt = block | ';' | localtype | local ';' | sexpr ';' | 'if' '(' expr ')' stmt ('else' stmt)?
 | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' forhead ')' stmt
 | 'return' expr? ';' | 'break' ident? ';' | 'continue' ident? ';' | 'throw' expr ';' | 'yield' expr ';'
 | 'assert' expr (':' expr)? ';' | 'synchronized' '(' expr ')' block | ident ':' stmt
 | 'try' ('(' resource (';' resource)* ';'? ')' block catch* finally? | block (catch+ finally? | finally)) | 'switch' '(' expr ')' switchbody
localtype = mods (class | iface | enum | record)
local = (('final' | annot))* type ident dims ('=' varinit)? (',' ident dims ('=' varinit)?)*
resource = local | expr
catch = 'catch' '(' ('final' | annot)* type ('|' type)* ident ')' block
finally = 'finally' block
forhead = (local | sexpr (',' sexpr)*)? ';' expr? ';' (sexpr (',' sexpr)*)? | ('final' | annot)* type ident ':' expr
switchbody = '{' (label+ stmt* | arm)* '}'
label = ('case' caseval (',' caseval)* | 'default') ':'
arm = ('case' caseval (',' caseval)* | 'default') '->' (expr ';' | block | 'throw' expr ';')
caseval = ternary | 'default' | pattern
pattern = 'final'? type ident | type '(' (pattern (',' pattern)*)? ')' ident?
sexpr = expr
args = expr (',' expr)*
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>=' | '>' '>=' | '>' '>' '>='
binop = '+' | '-' | '*' | '/' | '%' | '<' | '<=' | '>' | '>=' | '==' | '!=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>'
expr = unary (tail | assignop unary)*
ternary = unary tail*
tail = binop unary | 'instanceof' (pattern | 'final'? type) | '?' expr ':' unary
unary = (('+' | '-' | '!' | '~' | '++' | '--' | '(' type ('&' type)* ')'))* (postfix | lambda)
postfix = primary suffix* ('++' | '--')*
lambda = (ident | '(' (lparam (',' lparam)*)? ')') '->' (expr | block)
lparam = param | ident
primary = NUM | STR | 'true' | 'false' | 'null' | ident | 'this' | 'super' | '(' expr ')' | new | prim dims | 'switch' '(' expr ')' switchbody
 | ident targs dims '::' ('new' | ident)
suffix = '.' (targs? (ident | 'super') | 'this' | 'class' | new) | '(' args? ')' | '[' expr? ']' | '::' targs? (ident | 'new')
new = 'new' targs? annot* (prim | ident targs? ('.' ident targs?)*) ('(' args? ')' classbody? | ('[' expr? ']')+ | ('[' ']')+ arrayinit)
"""

JS = r"""
unit = item*
item = stmt | import | export
word = ID | KW | 'get' | 'set' | 'static' | 'async' | 'of' | 'from' | 'as' | 'type' | 'let' | 'await' | 'yield' | 'function' | 'class' | 'new' | 'var' | 'const' | 'if' | 'else' | 'for' | 'while' | 'do' | 'return' | 'break' | 'continue' | 'throw' | 'try' | 'catch' | 'finally' | 'switch' | 'case' | 'default' | 'import' | 'export' | 'extends' | 'super' | 'this' | 'null' | 'true' | 'false' | 'typeof' | 'void' | 'delete' | 'in' | 'instanceof' | 'debugger' | 'with'
ident = ID | 'get' | 'set' | 'static' | 'async' | 'of' | 'from' | 'as' | 'type' | 'let' | 'await' | 'yield'
import = 'import' (STR | ident (',' (named | '*' 'as' ident))? 'from' STR | named 'from' STR | '*' 'as' ident 'from' STR) attrs? ';'
attrs = ('with' | ID) '{' (prop (',' prop)*)? ','? '}'
named = '{' (spec (',' spec)*)? ','? '}'
spec = (word | STR) ('as' (word | STR))?
export = 'export' (named ('from' STR attrs?)? ';' | '*' ('as' (word | STR))? 'from' STR attrs? ';' | 'default' (function | class | expr ';') | decl)
decl = vardecl ';' | function | class
vardecl = ('var' | 'let' | 'const') binding (',' binding)*
binding = target ('=' asg)?
target = ident | '[' (target0 | ',' | '...' target)* ']' | '{' (pprop (',' pprop)*)? ','? '}'
target0 = target ('=' asg)?
pprop = '...' ident | propname ':' target ('=' asg)? | ident ('=' asg)?
propname = word | STR | NUM | '[' asg ']'
block = '{' stmt* '}'
stmt = block | ';' | decl | expr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'?
 | 'for' 'await'? '(' forhead ')' stmt | 'return' expr? ';' | 'break' ident? ';' | 'continue' ident? ';' | 'throw' expr ';'
 | 'try' block (catch finally? | finally) | 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' stmt*)* '}' | ident ':' stmt | 'debugger' ';' | 'with' '(' expr ')' stmt
catch = 'catch' ('(' target ')')? block
finally = 'finally' block
forhead = (vardecl | expr)? ';' expr? ';' expr? | (('var' | 'let' | 'const') target | postfix) ('of' | 'in') expr
function = 'async'? 'function' '*'? ident params block
fexpr = 'async'? 'function' '*'? ident? params block
params = '(' (param (',' param)*)? ','? ')'
param = '...' target | target ('=' asg)?
class = 'class' ident ('extends' postfix)? classbody
cexpr = 'class' ident? ('extends' postfix)? classbody
classbody = '{' member* '}'
member = ';' | 'static'? (method | field ';') | 'static' block
method = 'async'? '*'? (propname | PRIVATE) params block | ('get' | 'set') (propname | PRIVATE) params block
field = (propname | PRIVATE) ('=' asg)?
expr = asg (',' asg)*
asg = unary tail* | arrow
tail = binop (unary | arrow) | assignop (unary | arrow) | '?' asg ':' (unary | arrow)
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '>>>=' | '**=' | '&&=' | '||=' | '??='
binop = '+' | '-' | '*' | '/' | '%' | '**' | '<' | '<=' | '>' | '>=' | '==' | '!=' | '===' | '!==' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | '>>' | '>>>' | 'in' | 'instanceof'
unary = ('+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await')* (postfix ('++' | '--')? | yield)
yield = 'yield' ('*'? asg)?
arrow = 'async'? (ident | params) '=>' (block | asg)
postfix = primary suffix*
primary = NUM | STR | TEMPLATE | REGEX | 'true' | 'false' | 'null' | 'this' | 'super' | ident | '(' expr ')' | array | object | fexpr | cexpr | 'new' '.' ID | 'new' primary2 | 'import' ('(' asg (',' asg)? ','? ')' | '.' ID) | PRIVATE
primary2 = primary
array = '[' (asg | '...' asg | ',')* ']'
object = '{' (prop (',' prop)*)? ','? '}'
prop = '...' asg | propname ':' asg | ident ('=' asg)? | method
suffix = ('.' | '?.') (word | PRIVATE) | '?.'? '[' expr ']' | '?.'? '(' args ')' | TEMPLATE
args = (arg (',' arg)*)? ','?
arg = '...'? asg
"""

_TS_TYPES = r"""
type = tfun | tcond
tcond = tunion ('extends' tunion '?' type ':' type)?
tunion = ('|' | '&')? tpre (('|' | '&') tpre)*
tpre = ('keyof' | 'unique' | 'readonly' | 'infer' | 'typeof')* tpost
tpost = tatom ('[' type? ']')*
tatom = tname targs? ('.' word targs?)* | STR | NUM | '-' NUM | TEMPLATE | 'null' | 'this' | 'true' | 'false' | 'void' | '{' tmember* '}' | '[' (telem (',' telem)*)? ','? ']' | '(' type ')' | 'import' '(' STR ')' ('.' word)* targs?
tname = ident
telem = '...'? (word '?'? ':')? type '?'?
tfun = ('new' | 'abstract' 'new')? tparams? params '=>' (type | tpred)
tpred = 'asserts'? (ident | 'this') 'is' type | 'asserts' (ident | 'this')
targs = '<' type (',' type)* '>'
tparams = '<' tparam (',' tparam)* ','? '>'
tparam = ('const' | 'in' | 'out')* ident ('extends' type)? ('=' type)?
tmember = tmem (';' | ',')?
tmem = ('readonly' | '+' | '-')* (propname '?'? (':' type)? | '[' ident ('in' type ('as' type)? | ':' type) ']' (('+' | '-')? '?')? (':' type)?) | ('get' | 'set')? propname '?'? tparams? params (':' (type | tpred))? | 'new'? tparams? params (':' (type | tpred))?
tann = ':' type
"""


def _typescript() -> str:
    t = JS
    soft = " | 'readonly' | 'keyof' | 'unique' | 'infer' | 'is' | 'asserts' | 'abstract' | 'declare' | 'namespace' | 'module' | 'public' | 'private' | 'protected' | 'override' | 'satisfies' | 'out' | 'accessor' | 'global'"
    swap = {
        "word = ID": "word = 'interface' | 'enum' | 'implements'" + soft + " | ID",
        "ident = ID": "ident = ID" + soft,
        "import = 'import' (": "import = 'import' ident '=' (ident ('.' ident)* | ID '(' STR ')') ';' | 'import' 'type'? (",
        "spec = ": "spec = 'type'? ",
        "export = 'export' (": "export = 'export' '=' expr ';' | 'export' 'as' 'namespace' ident ';' | 'export' ('type' named ('from' STR)? ';' | 'default' (interface | 'abstract' class) | deco* ",
        "decl = ": "decl = deco* 'abstract'? class | 'declare'? (interface | alias | enum | namespace) | 'declare' (decl | 'global' block) | tsfun ';' | ",
        "binding = target": "binding = target '!'? tann?",
        "catch = 'catch' ('(' target ')')? block": "catch = 'catch' ('(' target tann? ')')? block",
        "function = 'async'? 'function' '*'? ident params block": "tsfun = 'async'? 'function' '*'? ident tparams? params (':' (type | tpred))?\nfunction = 'async'? 'function' '*'? ident tparams? params (':' (type | tpred))? block",
        "fexpr = 'async'? 'function' '*'? ident? params block": "fexpr = 'async'? 'function' '*'? ident? tparams? params (':' (type | tpred))? block",
        "param = '...' target | target ('=' asg)?": "param = deco* ('public' | 'private' | 'protected' | 'readonly' | 'override')* ('...' target tann? | (target | 'this') '?'? tann? ('=' asg)?)",
        "class = 'class' ident ('extends' postfix)? classbody": "class = 'class' ident tparams? ('extends' postfix targs?)? ('implements' type (',' type)*)? classbody\ninterface = 'interface' ident tparams? ('extends' type (',' type)*)? '{' tmember* '}'\nalias = 'type' ident tparams? '=' type ';'\nenum = 'const'? 'enum' ident '{' (propname ('=' asg)? (',' propname ('=' asg)?)*)? ','? '}'\nnamespace = ('namespace' | 'module') (ident ('.' ident)* | STR) ('{' item* '}' | ';')\ndeco = '@' postfix",
        "cexpr = 'class' ident? ('extends' postfix)? classbody": "cexpr = 'class' ident? tparams? ('extends' postfix targs?)? ('implements' type (',' type)*)? classbody",
        "member = ';' | 'static'? (method | field ';') | 'static' block": "member = ';' | deco* cmod* (method | field ';' | sig ';') | 'static' block\ncmod = 'static' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'async' | 'accessor'\nsig = '*'? (propname | PRIVATE) '?'? tparams? params (':' (type | tpred))? | '[' ident ':' type ']' tann | ('get' | 'set') propname params tann?",
        "method = 'async'? '*'? (propname | PRIVATE) params block | ('get' | 'set') (propname | PRIVATE) params block": "method = 'async'? '*'? (propname | PRIVATE) '?'? tparams? params (':' (type | tpred))? block | ('get' | 'set') (propname | PRIVATE) params tann? block",
        "field = (propname | PRIVATE)": "field = (propname | PRIVATE) ('?' | '!')? tann?",
        "tail = binop": "tail = ('as' | 'satisfies') ('const' | type) | binop",
        "binop = '+'": "binop = '>' '>' | '>' '>' '>' | '+'",
        "assignop = '='": "assignop = '>' '>=' | '>' '>' '>=' | '='",
        "unary = ('+'": "unary = ('<' type '>' | '+'",
        "arrow = 'async'? (ident | params) '=>'": "arrow = 'async'? (ident | tparams? params (':' (type | tpred))?) '=>'",
        "suffix = ": "suffix = '!' | targs ('(' args ')' | TEMPLATE)? | ",
    }
    for a, b in swap.items():
        if f"\n{a}" not in t:
            raise AssertionError(a)
        t = t.replace(f"\n{a}", f"\n{b}", 1)
    return t + _TS_TYPES


TS = _typescript()

PYTHON = r"""
unit = NEWLINE? stmt*
stmt = compound | simple (';' simple)* ';'? NEWLINE
ident = ID | 'match' | 'case' | 'type' | '_'
block = NEWLINE INDENT stmt+ DEDENT | simple (';' simple)* ';'? NEWLINE
simple = 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (test ('from' test)?)? | 'global' ident (',' ident)* | 'nonlocal' ident (',' ident)* | 'del' test (',' test)* ','?
 | 'assert' test (',' test)? | 'import' dotted ('as' ident)? (',' dotted ('as' ident)?)* | 'from' ('.' | '...')* dotted? 'import' ('*' | names | '(' names ','? ')')
 | 'type' ident tparams? '=' test | stars (':' test ('=' (stars | yield))? | augop (stars | yield) | ('=' (stars | yield))*) | yield
augop = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**='
dotted = ident ('.' ident)*
names = ident ('as' ident)? (',' ident ('as' ident)?)*
yield = 'yield' ('from' test | stars)?
compound = 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)? | 'while' named ':' block ('else' ':' block)? | 'async'? 'for' targets 'in' stars ':' block ('else' ':' block)?
 | 'try' ':' block (('except' '*'? (test ('as' ident)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block)
 | 'async'? 'with' (withitem (',' withitem)* | '(' withitem (',' withitem)* ','? ')') ':' block
 | deco* ('async'? 'def' ident tparams? '(' (param (',' param)*)? ','? ')' ('->' test)? ':' block | 'class' ident tparams? ('(' args ')')? ':' block)
 | 'match' stars ':' NEWLINE INDENT ('case' patterns ('if' named)? ':' block)+ DEDENT
tparams = '[' (('*' | '**')? ident (':' test)? ('=' test)? ','?)+ ']'
deco = '@' named NEWLINE
withitem = test ('as' target)?
targets = star0 (',' star0)* ','?
star0 = '*'? bitor
target = '*'? postfix | '(' (star0 (',' star0)*)? ','? ')' | '[' (star0 (',' star0)*)? ','? ']'
param = '*' (ident (':' test)?)? | '**' ident (':' test)? | '/' | ident (':' '*'? test)? ('=' test)?
patterns = pat (',' pat)* ','?
pat = '*'? por ('as' ident)?
por = pclosed ('|' pclosed)*
pclosed = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | ident ('.' ident)* ('(' (parg (',' parg)*)? ','? ')')? | '(' patterns? ')' | '[' patterns? ']' | '{' (pkey (',' pkey)*)? ','? '}'
parg = (ident '=')? pat
pkey = '**' ident | ('-'? NUM | STR+ | 'None' | 'True' | 'False' | ident ('.' ident)+) ':' pat
stars = star (',' star)* ','?
star = '*' bitor | named
named = test (':=' test)?
test = lambda | or ('if' or 'else' test)?
lambda = 'lambda' (lparam (',' lparam)*)? ','? ':' test
lparam = '*' ident? | '**' ident | '/' | ident ('=' test)?
or = and ('or' and)*
and = not ('and' not)*
not = 'not'* cmp
cmp = bitor (('<' | '>' | '<=' | '>=' | '==' | '!=' | 'in' | 'not' 'in' | 'is' 'not'?) bitor)*
bitor = unary (('|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**') unary)*
unary = ('+' | '-' | '~')* 'await'? postfix
postfix = atom suffix*
suffix = '.' ident | '(' args ')' | '[' sub (',' sub)* ','? ']'
sub = '*'? named | test? ':' test? (':' test?)?
atom = ident | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' (yield | stars | named comp)? ')' | '[' (stars | named comp)? ']' | '{' (dict | stars | named comp)? '}'
dict = ditem (',' ditem)* ','? | test ':' test comp
ditem = '**' bitor | test ':' test
comp = ('async'? 'for' targets 'in' or ('if' cond)*)+
cond = or | lambda | named
args = (arg (',' arg)*)? ','?
arg = '*' test | '**' test | ident '=' test | named comp?
"""

SQL = r"""
unit = (stmt? ';')* stmt?
stmt = create | insert | select | update | delete | alter | drop | other
other = VERB soup+ | 'BEGIN' soup* | 'END' soup*
soup = ID | NUM | STR | OP | '*' | '.' | ',' | '=' | '(' soup* ')' | '[' soup* ']' | '{' soup* '}' | ':' | anyword
soft = 'KEY' | 'TYPE' | 'INDEX' | 'VIEW' | 'FIRST' | 'ACTION' | 'CASCADE' | 'IF' | 'REPLACE' | 'COLUMN' | 'ADD' | 'TEMP' | 'MODIFIER' | 'RENAME' | 'BEGIN' | 'END' | 'VERB' | VERB | 'SCHEMA' | 'SEQUENCE' | 'ROLE' | 'OBJ' | OBJ | MODIFIER
anyword = soft | 'CREATE' | 'TABLE' | 'SELECT' | 'FROM' | 'WHERE' | 'INSERT' | 'INTO' | 'VALUES' | 'UPDATE' | 'SET' | 'DELETE' | 'ALTER' | 'DROP' | 'NOT' | 'NULL' | 'DEFAULT' | 'PRIMARY' | 'UNIQUE' | 'REFERENCES' | 'FOREIGN' | 'CHECK' | 'CONSTRAINT' | 'AND' | 'OR' | 'AS' | 'ON' | 'JOIN' | 'JOINWORD' | JOINWORD | 'GROUP' | 'ORDER' | 'BY' | 'HAVING' | 'LIMIT' | 'UNION' | 'CASE' | 'WHEN' | 'THEN' | 'ELSE' | 'IN' | 'IS' | 'LIKE' | 'BETWEEN' | 'EXISTS' | 'DISTINCT' | 'ALL' | 'CAST' | 'INTERVAL' | 'WITH' | 'USING' | 'DESC' | 'OVER' | 'RETURNING' | 'OFFSET' | 'FETCH' | 'COLLATE' | 'GENERATED'
ident = ID | soft
name = ident ('.' (ident | '*'))*
create = 'CREATE' ('OR' 'REPLACE')? MODIFIER* 'TEMP'? (createtable | 'UNIQUE'? 'INDEX' soup+ | 'VIEW' exists? name ('(' ident (',' ident)* ')')? 'AS' select | ('SCHEMA' | 'SEQUENCE' | 'ROLE' | 'TYPE' | OBJ | 'UNIQUE') soup+)
exists = 'IF' 'NOT'? 'EXISTS'
createtable = 'TABLE' exists? name ('(' colitem (',' colitem)* ')' tabopt* ('AS' select)? | 'AS' select | 'LIKE' name)
tabopt = soup
colitem = tabcon | ident coltype? colcon*
coltype = (ID | 'INTERVAL' | soft) (ID | soft)* ('(' (NUM | ID | STR) (',' (NUM | STR))* (ID)? ')')? (TYPEWORD)* ('[' NUM? ']')*
colcon = ('CONSTRAINT' ident)? ('NOT'? 'NULL' | 'DEFAULT' simple | 'PRIMARY' 'KEY' ('DESC' | MODIFIER)? | 'UNIQUE' 'KEY'? | 'KEY' | references | 'CHECK' '(' expr ')' | 'COLLATE' ident | MODIFIER | 'GENERATED' soup+ | 'ON' ('UPDATE' | 'DELETE') simple)
references = 'REFERENCES' name ('(' ident (',' ident)* ')')? ('ON' ('DELETE' | 'UPDATE') ('CASCADE' | 'SET' ('NULL' | 'DEFAULT') | MODIFIER 'ACTION'?))*
tabcon = ('CONSTRAINT' ident)? ('PRIMARY' 'KEY' MODIFIER? '(' key (',' key)* ')' | 'UNIQUE' ('KEY' | 'INDEX')? ident? '(' key (',' key)* ')' | 'FOREIGN' 'KEY' ident? '(' ident (',' ident)* ')' references | 'CHECK' '(' expr ')' | ('INDEX' | 'KEY') ident? '(' key (',' key)* ')' | 'LIKE' name)
key = expr 'DESC'?
insert = with? 'INSERT' ('OR' 'REPLACE' | MODIFIER)* 'INTO' 'TABLE'? name ('AS' ident)? ('(' name (',' name)* ')')? MODIFIER* ('VALUES' row (',' row)* | select | 'DEFAULT' 'VALUES' | 'SET' assign (',' assign)*) ('ON' soup+)? returning?
row = '(' value (',' value)* ')'
value = expr | 'DEFAULT'
returning = 'RETURNING' items
update = with? 'UPDATE' name ('AS'? ident)? 'SET' assign (',' assign)* ('FROM' sources)? where? returning?
assign = name '=' value | '(' name (',' name)* ')' '=' expr
delete = with? 'DELETE' 'FROM' name ('AS'? ident)? ('USING' sources)? where? returning?
where = 'WHERE' expr
alter = 'ALTER' ('TABLE' exists? name alteration (',' alteration)* | ('SCHEMA' | 'SEQUENCE' | 'ROLE' | 'TYPE' | 'VIEW' | 'INDEX' | OBJ | MODIFIER) soup+)
alteration = 'ADD' ('COLUMN'? exists? (tabcon | colitem | '(' colitem (',' colitem)* ')')) | 'DROP' soup+ | 'RENAME' soup+ | 'ALTER' soup+ | ('SET' | ID | soft) soup+
drop = 'DROP' soup+
with = 'WITH' ident? cte (',' cte)*
cte = ident ('(' ident (',' ident)* ')')? 'AS' ('NOT'? ID)? '(' (select | insert | update | delete) ')'
select = with? selcore (('UNION' | JOINWORD) ('ALL' | 'DISTINCT')? selcore)* orderby? limit*
selcore = 'SELECT' ('DISTINCT' ('ON' '(' items ')')? | 'ALL')? items ('INTO' name)? ('FROM' sources)? where? ('GROUP' 'BY' items)? ('HAVING' expr)? | '(' select ')' | 'VALUES' row (',' row)*
items = item (',' item)*
item = '*' | expr (('AS' (ident | STR)) | ident)?
sources = source (',' source)*
source = table (JOINWORD* 'JOIN' table ('ON' expr | 'USING' '(' ident (',' ident)* ')')?)*
table = (name | '(' (select | sources) ')' | name '(' exprs? ')') ('AS'? ident ('(' ident (',' ident)* ')')?)?
orderby = 'ORDER' 'BY' okey (',' okey)*
okey = expr 'DESC'? (ident ('FIRST' | ident))?
limit = 'LIMIT' expr (',' expr)? | 'OFFSET' expr ident? | 'FETCH' soup+
exprs = expr (',' expr)*
expr = prefix* operand (op prefix* operand | 'IS' 'NOT'? ('NULL' | ident | 'DISTINCT' 'FROM' operand) | 'NOT'? 'IN' ('(' (select | exprs) ')' | operand) | 'NOT'? 'BETWEEN' simple 'AND' operand | 'COLLATE' ident)*
prefix = 'NOT' | OP
op = 'AND' | 'OR' | OP | '=' | '*' | 'NOT'? 'LIKE'
simple = OP* operand (OP prefix* operand | '*' operand)*
operand = (NUM | STR+ | 'NULL' | call | '(' (select | exprs) ')' | 'CASE' expr? ('WHEN' expr 'THEN' expr)+ ('ELSE' expr)? 'END' | 'CAST' '(' expr 'AS' coltype ')' | 'EXISTS' '(' select ')' | 'INTERVAL' (STR | NUM | operand) ident? | '{' soup* '}' | ':' ident | 'REPLACE' '(' exprs ')') (':' ':' coltype | '[' expr ']')*
call = name ('(' (('DISTINCT' | 'ALL')? ('*' | exprs | select) orderby?)? ')' ('OVER' (ident | '(' soup* ')'))?)? | ident STR
"""
