"""Grammars of the languages whose files are parsed, in the notation of ``grammar``.

They accept what the languages' published grammars accept, without types,
names and other static rules; operators share one level, since only
acceptance is asked for.
"""

from __future__ import annotations

JSON = """
Text = Value ;
Value = '{' (Member % ',')? '}' | '[' (Value % ',')? ']' | STR | NUM | 'true' | 'false' | 'null' ;
Member = STR ':' Value ;
"""

TOML = """
Text = Line? (NEWLINE Line?)* ;
Line = Key '=' Value | '[' Key ']' | '[[' Key ']]' ;
Key = Part % '.' ;
Part = BARE | STR ;
Value = STR | MSTR | NUM | 'true' | 'false' | '{' (Pair % ',')? '}' | '[' NEWLINE* (Item (Comma Item)* Comma?)? ']' ;
Item = Value NEWLINE* ;
Comma = ',' NEWLINE* ;
Pair = Key '=' Value ;
"""

XML = """
Text = Misc* (DOCTYPE Misc*)? Element Misc* | DECL Misc* (DOCTYPE Misc*)? Element Misc* ;
Misc = COMMENT | PI | BLANK ;
Element = EMPTY | OPEN Content* CLOSE ;
Content = Element | TEXT | BLANK | CDATA | COMMENT | PI ;
"""

YAML = """
Stream = Doc? (Mark Doc?)* ;
Mark = '---' | '...' ;
Doc = Node ;
Node = Inline NEWLINE | Block | Props NEWLINE? Block | Props NEWLINE ;
Block = Mapping | Sequence | INDENT Block DEDENT ;
Mapping = Entry+ ;
Entry = Key ':' Tail | '?' Tail | ':' Tail ;
Key = SCALAR | Props SCALAR | Flow | Props Flow | ALIAS ;
Tail = Inline NEWLINE | Props? NEWLINE | Props? NEWLINE INDENT Block DEDENT | Props? NEWLINE Sequence | Props? BLOCKTEXT ;
Sequence = Item+ ;
Item = '-' Inline NEWLINE | '-' Props? NEWLINE | '-' Props? NEWLINE INDENT Block DEDENT | '-' Props? BLOCKTEXT | '-' INDENT Block DEDENT | '-' Props INDENT Block DEDENT ;
Inline = SCALAR | ALIAS | Flow | Props SCALAR | Props Flow ;
Props = PROP+ ;
Flow = '[' FlowItems? ']' | '{' FlowItems? '}' ;
FlowItems = FlowItem (',' FlowItem)* ','? ;
FlowItem = FlowNode | FlowNode ':' FlowNode? | '?' FlowNode (':' FlowNode?)? | ':' FlowNode? ;
FlowNode = SCALAR | ALIAS | Flow | Props SCALAR? | Props Flow ;
"""



def _parameters(name: str, one: str, starred: str) -> str:
    """Parameter lists: plain ones, then those with defaults, one slash among them, then what follows a star."""
    n = name
    return f"""
{n} = {n}N {n}A | {n}D {n}B | {n}S ;
{n}N = {one} ;
{n}D = {one} '=' Expr ;
{n}A = | ',' | ',' {n}N {n}A | ',' {n}D {n}B | ',' '/' {n}P | ',' {n}S ;
{n}B = | ',' | ',' {n}D {n}B | ',' '/' {n}Q | ',' {n}S ;
{n}P = | ',' | ',' {n}N {n}P | ',' {n}D {n}Q | ',' {n}S ;
{n}Q = | ',' | ',' {n}D {n}Q | ',' {n}S ;
{n}S = '*' {starred} {n}K | '*' ',' ({n}N | {n}D) {n}K | {n}W ;
{n}K = | ',' | ',' ({n}N | {n}D) {n}K | ',' {n}W ;
{n}W = '**' {one} ','? ;
"""


PYTHON = """
File = (Stmt | NEWLINE)* ;
Stmt = Simple | Compound ;
Simple = Small (';' Small)* ';'? NEWLINE ;
Small = Exprs | (Targets '=')+ Right | Single AUG Right | Single ':' Expr ('=' Right)?
  | 'pass' | 'break' | 'continue' | 'return' Exprs? | Yield | 'raise' (Expr ('from' Expr)?)? | ('global' | 'nonlocal') (Name % ',')
  | 'del' Deleted | 'assert' Expr (',' Expr)? | 'import' (Dotted ('as' Name)?) % ','
  | 'from' ('.' | '...')* Dotted 'import' Imported | 'from' ('.' | '...')+ 'import' Imported | 'type' Name TypeParams? '=' Expr ;
Imported = '*' | (As % ',') | '(' (As % ',') ','? ')' ;
As = Name ('as' Name)? ;
Dotted = Name % '.' ;
Right = Exprs | Yield ;
Yield = 'yield' Exprs? | 'yield' 'from' Expr ;
Suite = Simple | NEWLINE INDENT Stmt+ DEDENT ;
Compound = 'if' Named ':' Suite ('elif' Named ':' Suite)* ('else' ':' Suite)? | 'while' Named ':' Suite ('else' ':' Suite)?
  | 'async'? 'for' Targets 'in' Exprs ':' Suite ('else' ':' Suite)? | 'async'? 'with' Withs ':' Suite | Try
  | Decorator* 'async'? 'def' Name TypeParams? '(' Params? ')' ('->' Exprs)? ':' Suite | Decorator* 'class' Name TypeParams? ('(' Bases? ')')? ':' Suite
  | 'match' Exprs ':' NEWLINE INDENT Case+ DEDENT ;
Decorator = '@' Named NEWLINE ;
TypeParams = '[' (TypeParam % ',') ','? ']' ;
TypeParam = ('*' | '**')? Name (':' Expr)? ('=' Expr)? ;
Try = 'try' ':' Suite Except+ ('else' ':' Suite)? ('finally' ':' Suite)? | 'try' ':' Suite 'finally' ':' Suite ;
Except = 'except' '*'? (Exprs ('as' Name)?)? ':' Suite ;
Withs = (With % ',') | '(' (With % ',') ','? ')' ;
With = Expr ('as' Target)? ;
Case = 'case' Patterns ('if' Named)? ':' Suite ;
Patterns = Pattern (',' Pattern)* ','? ;
Pattern = OrPat ('as' Name)? | '*' Name ;
OrPat = ClosedPat % '|' ;
ClosedPat = '-'? NUM (('+' | '-') NUM)? | STR+ | BYTES+ | 'None' | 'True' | 'False' | Dotted | '(' Patterns? ')' | '[' Patterns? ']'
  | '{' (KeyPat (',' KeyPat)* ','?)? '}' | Dotted '(' (ArgPat (',' ArgPat)* ','?)? ')' ;
KeyPat = ClosedPat ':' Pattern | '**' Name ;
ArgPat = Pattern | Name '=' Pattern ;
""" + _parameters("Params", "Name (':' Expr)?", "Name (':' Star)?") + _parameters("LambdaParams", "Name", "Name") + """
Star = Expr | '*' Power ;
Targets = Target (',' Target)* ','? ;
Target = '*'? Place ;
Place = Name | Power '.' Name | Power '[' Slices ']' | '(' Targets? ')' | '[' Targets? ']' ;
Single = Name | Power '.' Name | Power '[' Slices ']' | '(' Single ')' ;
Deleted = Gone (',' Gone)* ','? ;
Gone = Name | Power '.' Name | Power '[' Slices ']' | '(' Deleted? ')' | '[' Deleted? ']' ;
Exprs = One (',' One)* ','? ;
One = Named | '*' Bin ;
Named = Expr | Name ':=' Expr ;
Expr = Bin | Bin 'if' Bin 'else' Expr | 'lambda' LambdaParams? ':' Expr ;
Bin = Not | Bin LOGIC Not ;
Not = Sum | 'not' Not ;
Sum = Unary | Sum OP Unary | Sum 'not' 'in' Unary | Sum 'is' 'not' Unary | Sum 'in' Unary | Sum 'is' Unary | Sum '-' Unary | Sum '+' Unary | Sum '*' Unary | Sum '**' Unary | Sum '/' Unary | Sum '|' Unary | Sum '@' Unary ;
Unary = Power | ('-' | '+' | '~') Unary ;
Power = Atom | 'await' Atom | Power '.' Name | Power '(' Args? ')' | Power '[' Slices ']' ;
Args = Bases | Named Comp ;
Bases = (Given % ',') ','? | (Given % ',') ',' Keywords ','? | Keywords ','? ;
Given = Named | '*' Expr ;
Keywords = (Keyword % ',') | (Keyword % ',') ',' (Spread % ',') | (Spread % ',') ;
Keyword = Name '=' Expr | '*' Expr ;
Spread = Name '=' Expr | '**' Expr ;
Slices = Slice (',' Slice)* ','? ;
Slice = Named | '*' Bin | Expr? ':' Expr? (':' Expr?)? | Expr? ':=' Expr ;
Comp = CompFor+ ;
CompFor = 'async'? 'for' Targets 'in' Bin CompIf* ;
CompIf = 'if' CondIf ;
CondIf = Bin | 'lambda' LambdaParams? ':' Expr | Name ':=' Bin ;
Atom = Name | NUM | STR+ | BYTES+ | '...' | 'None' | 'True' | 'False' | '(' Exprs? ')' | '(' Yield ')' | '(' Named Comp ')' | '[' Exprs? ']' | '[' Named Comp ']'
  | '{' Exprs '}' | '{' Named Comp '}' | '{' (Pair (',' Pair)* ','?)? '}' | '{' Expr ':' Expr Comp '}' ;
Pair = Expr ':' Expr | '**' Bin ;
Name = ID | 'match' | 'case' | 'type' ;
"""

_WORDS = (
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch "
    "this throw true try typeof var void while with enum"
).split()
_SOFT = "as async await from get let of set static yield type interface namespace module declare abstract public private protected readonly keyof infer is asserts satisfies override implements accessor require global unique out".split()


def _names(words: list[str]) -> str:
    return " | ".join(f"'{w}'" for w in words)


def _expressions(suffix: str, objects: bool, functions: bool, typed: bool) -> str:
    s = suffix
    return f"""
Expr{s} = Assign{s} | Expr{s} ',' Assign ;
Assign{s} = Bin{s} | Bin{s} '?' Assign ':' Assign | Lhs{s} AOP Assign | Lhs{s} '=' Assign | Lhs{s} '>' '>=' Assign | Lhs{s} '>' '>' '>=' Assign | Arrow | 'yield' | 'yield' Assign | 'yield' '*' Assign ;
Bin{s} = Un{s} | Bin{s} BinOp Un {"| Bin" + s + " 'as' Type | Bin" + s + " 'as' 'const' | Bin" + s + " 'satisfies' Type" if typed else ""} ;
Un{s} = Post{s} | Prefix Un {"| '<' Type '>' Un" if typed and not s else ""} ;
Post{s} = Lhs{s} | Lhs{s} '++' | Lhs{s} '--' ;
Lhs{s} = Prim{s} | Lhs{s} '.' Word | Lhs{s} '.' PRIV | Lhs{s} '?.' Word | Lhs{s} '?.' PRIV | Lhs{s} '?.' '[' Expr ']' | Lhs{s} '?.' Call | Lhs{s} '[' Expr ']' | Lhs{s} Call | Lhs{s} TEMPLATE
  | 'new' Lhs | 'new' '.' Word {"| Lhs" + s + " '!' | Lhs" + s + " TArgs Call | Lhs" + s + " TArgs TEMPLATE | Lhs" + s + " TArgs" if typed else ""} ;
Prim{s} = Name | NUM | STR | TEMPLATE | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | '(' Expr ')' | '[' Elements ']' | 'import' '(' Assign (',' Assign)? ','? ')' | 'import' '.' Word
  {"| Object" if objects else ""} {"| Function | Class" if functions else ""} ;
"""


def _statements(suffix: str, ann: str, typed: bool) -> str:
    """Statements outside of functions, or with suffix F inside of them, where a return may stand."""
    f = suffix
    return f"""
Stmt{f} = Block{f} | VarStmt | ';' | ExprS Semi | 'if' '(' Expr ')' Stmt{f} | 'if' '(' Expr ')' Stmt{f} 'else' Stmt{f} | 'for' 'await'? '(' ForHead ')' Stmt{f} | 'while' '(' Expr ')' Stmt{f}
  | 'do' Stmt{f} 'while' '(' Expr ')' Semi? | 'continue' Name? Semi | 'break' Name? Semi {"| 'return' Expr? Semi" if f else ""} | 'throw' Expr Semi | 'debugger' Semi
  | 'switch' '(' Expr ')' '{{' CaseClause{f}* '}}' | 'try' Block{f} 'catch' ('(' Binding {ann} ')')? Block{f} ('finally' Block{f})? | 'try' Block{f} 'finally' Block{f}
  | Function | Class | Name ':' Stmt{f} {"| TypeDecl" if typed else ""} ;
Block{f} = '{{' Stmt{f}* '}}' ;
CaseClause{f} = 'case' Expr ':' Stmt{f}* | 'default' ':' Stmt{f}* ;
"""


def _script(typed: bool) -> str:
    """The module grammar of JavaScript, or with types that of TypeScript."""
    ann = "(':' Type)?" if typed else ""
    ret = "(':' Type)?" if typed else ""
    tp = "TParams?" if typed else ""
    opt = "'?'?" if typed else ""
    body = "(FBody | Semi)" if typed else "FBody"
    heritage = "('extends' Lhs TArgs?)? ('implements' (TypeRef % ','))?" if typed else "('extends' Lhs)?"
    mods = "Modifier*" if typed else "'static'?"
    text = f"""
Module = Item* ;
Item = Stmt | Import | Export ;
Import = 'import' STR Attrs? Semi | 'import' {"'type'?" if typed else ""} Clause 'from' STR Attrs? Semi {"| 'import' 'type'? Name '=' Expr Semi" if typed else ""} ;
Attrs = 'with' Object ;
Clause = Name | Named | Space | Name ',' Named | Name ',' Space ;
Space = '*' 'as' Name ;
Named = '{{' (Spec (',' Spec)* ','?)? '}}' ;
Spec = {"'type'?" if typed else ""} Word ('as' Word)? | STR ('as' Word)? | Word 'as' STR ;
Export = 'export' VarStmt | 'export' Function | 'export' Class | 'export' 'default' Function | 'export' 'default' Class | 'export' 'default' AssignS Semi
  | 'export' '*' ('as' (Word | STR))? 'from' STR Attrs? Semi | 'export' {"'type'?" if typed else ""} Named ('from' STR Attrs?)? Semi
  {"| Decorator+ 'export' 'default'? Class | 'export' TypeDecl | 'export' '=' Expr Semi | 'export' 'default' TypeDecl | 'export' 'as' 'namespace' Name Semi | 'export' 'import' Name '=' Expr Semi" if typed else ""} ;
{_statements("", ann, typed)}{_statements("F", ann, typed)}Semi = ';' | ASI ;
VarStmt = VarKind (Declarator % ',') Semi ;
VarKind = 'var' | 'let' | 'const' ;
Declarator = Binding {"'!'?" if typed else ""} {ann} ('=' Assign)? ;
ForHead = VarKind (Declarator % ',') ';' Expr? ';' Expr? | Expr? ';' Expr? ';' Expr? | VarKind Binding {ann} 'of' Assign | VarKind Binding {ann} 'in' Expr | Lhs 'of' Assign | Lhs 'in' Expr ;
Binding = Name | '[' BindElems ']' | '{{' (BindProp (',' BindProp)* ','?)? '}}' ;
BindElems = BindElem? (',' BindElem?)* ;
BindElem = Binding ('=' Assign)? | '...' Binding ;
BindProp = PropName ':' Binding ('=' Assign)? | Name ('=' Assign)? | '...' Binding ;
Function = 'async'? 'function' '*'? Name? {tp} '(' Params? ')' {ret} {body} ;
FBody = '{{' StmtF* '}}' ;
Params = Param (',' Param)* ','? ;
Param = {"Decorator* ParamMod*" if typed else ""} Binding {opt} {ann} ('=' Assign)? | {"Decorator*" if typed else ""} '...' Binding {ann} {"| 'this' ':' Type" if typed else ""} ;
Arrow = 'async'? Name '=>' ArrowBody | 'async'? {tp} '(' Params? ')' {ret} '=>' ArrowBody ;
ArrowBody = AssignA | FBody ;
Class = {"Decorator* 'abstract'?" if typed else ""} 'class' Name? {tp} {heritage} '{{' Member* '}}' ;
Member = ';' | 'static' Block | {"Decorator*" if typed else ""} {mods} Method | {"Decorator*" if typed else ""} {mods} PropName {"('?' | '!')?" if typed else ""} {ann} ('=' Assign)? Semi
  {"| Modifier* '[' Name ':' Type ']' ':' Type Semi" if typed else ""} ;
Method = MethodMod? PropName {opt} {tp} '(' Params? ')' {ret} {body} ;
MethodMod = 'async' | '*' | 'async' '*' | 'get' | 'set' ;
PropName = Word | STR | NUM | PRIV | '[' Assign ']' ;
Object = '{{' (Prop (',' Prop)* ','?)? '}}' ;
Prop = PropName ':' Assign | Name ('=' Assign)? | '...' Assign | MethodMod? PropName {tp} '(' Params? ')' {ret} FBody ;
Elements = Element? (',' Element?)* ;
Element = Assign | '...' Assign ;
Call = '(' (CallArg (',' CallArg)* ','?)? ')' ;
CallArg = Assign | '...' Assign ;
Prefix = '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' ;
BinOp = BOP | '+' | '-' | '*' | '<' | '>' | '>=' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof' | '|' | '&' ;
Name = ID | {_names(_SOFT)} ;
Word = Name | {_names(_WORDS)} ;
"""
    text += _expressions("", True, True, typed) + _expressions("S", False, False, typed) + _expressions("A", False, True, typed)
    if typed:
        text += """
Modifier = 'static' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor' ;
ParamMod = 'public' | 'private' | 'protected' | 'readonly' | 'override' ;
Decorator = '@' Lhs ;
TypeDecl = 'interface' Name TParams? ('extends' (TypeRef % ','))? TypeBody | 'type' Name TParams? '=' Type Semi | 'const'? 'enum' Name '{' (EnumItem (',' EnumItem)* ','?)? '}'
  | ('namespace' | 'module') (Name % '.') ModuleBody | 'module' STR (ModuleBody | Semi) | 'global' ModuleBody | 'declare' Declared | 'abstract' Class ;
Declared = VarStmt | Function | Class | TypeDecl ;
ModuleBody = '{' Item* '}' ;
EnumItem = PropName ('=' Assign)? ;
TParams = '<' (TParam % ',') ','? '>' ;
TParam = ('const' | 'in' | 'out')* Name ('extends' Type)? ('=' Type)? ;
TArgs = '<' (Type % ',') '>' ;
TypeRef = Name ('.' Word)* TArgs? ;
Type = Union | Union 'extends' Union '?' Type ':' Type | TParams? '(' Params? ')' '=>' Type | 'abstract'? 'new' TParams? '(' Params? ')' '=>' Type | (Name | 'this') 'is' Type | 'asserts' (Name | 'this') ('is' Type)? ;
Union = ('|' | '&')? Postfix | Union ('|' | '&') Postfix | Union ('|' | '&') TParams? '(' Params? ')' '=>' Type ;
Postfix = Basic | Postfix '[' ']' | Postfix '[' Type ']' | ('keyof' | 'readonly' | 'unique') Postfix | 'infer' Name ('extends' Postfix)? | 'typeof' ('this' | Name) ('.' Word)* TArgs? | 'typeof' 'import' '(' STR ')' ;
Basic = TypeRef | STR | NUM | '-' NUM | TEMPLATE | 'void' | 'null' | 'this' | 'true' | 'false' | '(' Type ')' | '[' (TupleItem (',' TupleItem)* ','?)? ']' | TypeBody
  | '{' ('+' | '-')? 'readonly'? '[' Name 'in' Type ('as' Type)? ']' (('+' | '-')? '?')? (':' Type)? Semi? '}' | 'import' '(' STR ')' ('.' Word)* TArgs? ;
TupleItem = '...'? Type '?'? | '...'? Name '?'? ':' Type ;
TypeBody = '{' TypeMember* '}' ;
TypeMember = 'readonly'? PropName '?'? (':' Type)? Sep | ('get' | 'set')? PropName '?'? TParams? '(' Params? ')' (':' Type)? Sep | TParams? '(' Params? ')' (':' Type)? Sep | 'new' TParams? '(' Params? ')' (':' Type)? Sep
  | (('+' | '-')? 'readonly')? '[' Name ':' Type ']' ':' Type Sep ;
Sep = ';' | ',' | ASI ;
"""
    return text


JAVASCRIPT = _script(False)
TYPESCRIPT = _script(True)

JAVA = """
Unit = Package? (Import | ';')* (TypeDecl | ';')* | Modifier* 'open'? 'module' QName '{' Directive* '}' ;
Package = Annotation* 'package' QName ';' ;
Import = 'import' 'static'? QName ('.' '*')? ';' | 'import' 'module' QName ';' ;
Directive = 'requires' ('transitive' | 'static')* QName ';' | ('exports' | 'opens') QName ('to' (QName % ','))? ';' | 'uses' QName ';' | 'provides' QName 'with' (QName % ',') ';' ;
QName = Name % '.' ;
Modifier = 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' | Annotation ;
Annotation = '@' QName ('(' AnnArgs? ')')? ;
AnnArgs = ElemValue | ElemPair % ',' ;
ElemPair = Name '=' ElemValue ;
ElemValue = Tern | Annotation | '{' (ElemValue (',' ElemValue)* ','?)? '}' ;
TypeDecl = Modifier* TypeRest ;
TypeRest = 'class' Name TParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? ClassBody | 'interface' Name TParams? ('extends' Types)? ('permits' Types)? ClassBody
  | 'enum' Name ('implements' Types)? '{' (Constant (',' Constant)* ','?)? (';' Member*)? '}' | 'enum' Name ('implements' Types)? '{' ',' (';' Member*)? '}'
  | '@' 'interface' Name ClassBody | 'record' Name TParams? '(' (RecordPart % ',')? ')' ('implements' Types)? ClassBody ;
RecordPart = Modifier* Type '...'? Name ;
Constant = Annotation* Name Args? ClassBody? ;
ClassBody = '{' Member* '}' ;
Member = ';' | 'static'? Block | Modifier* TypeRest | Modifier* TParams? Type Name '(' Formals? ')' Dims? Throws? MethodEnd | Modifier* TParams? 'void' Name '(' Formals? ')' Throws? MethodEnd
  | Modifier* TParams? Name '(' Formals? ')' Throws? Block | Modifier* Name Block | Modifier* Type (Declarator % ',') ';' ;
MethodEnd = Block | ';' | 'default' ElemValue ';' ;
Throws = 'throws' Types ;
Formals = Formal % ',' ;
Formal = Modifier* Type Annotation* '...'? (Name | (Name '.')? 'this') Dims? ;
Types = Type % ',' ;
Type = Annotation* Simple Dims? ;
Simple = PRIMITIVE | Ref ;
Ref = Name TArgs? | Ref '.' Annotation* Name TArgs? ;
Dims = (Annotation* '[' ']')+ ;
TArgs = '<' (TArg % ',')? '>' ;
TArg = Type | Annotation* '?' (('extends' | 'super') Type)? ;
TParams = '<' (TParam % ',') '>' ;
TParam = Annotation* Name ('extends' (Type % '&'))? ;
Declarator = Name Dims? ('=' Init)? ;
Init = Expr | '{' (Init (',' Init)* ','?)? '}' ;
Block = '{' BlockStmt* '}' ;
BlockStmt = Stmt | Modifier* Type (Declarator % ',') ';' | Modifier* TypeRest ;
Stmt = Block | ';' | Expr ';' | 'if' '(' Expr ')' Stmt | 'if' '(' Expr ')' Stmt 'else' Stmt | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';'
  | 'for' '(' ForInit? ';' Expr? ';' (Expr % ',')? ')' Stmt | 'for' '(' Modifier* Type Name ':' Expr ')' Stmt | 'return' Expr? ';' | 'break' Name? ';' | 'continue' Name? ';' | 'throw' Expr ';'
  | 'yield' Expr ';' | 'assert' Expr (':' Expr)? ';' | 'synchronized' '(' Expr ')' Block | Switch | Name ':' Stmt
  | 'try' Block Catch* 'finally' Block | 'try' Block Catch+ | 'try' '(' (Resource (';' Resource)* ';'?) ')' Block Catch* ('finally' Block)? ;
ForInit = Expr % ',' | Modifier* Type (Declarator % ',') ;
Catch = 'catch' '(' Modifier* (Type % '|') Name ')' Block ;
Resource = Modifier* Type Name '=' Expr | Post ;
Switch = 'switch' '(' Expr ')' '{' Group* '}' ;
Group = Label ':' BlockStmt* | Label '->' (Expr ';' | Block | 'throw' Expr ';') ;
Label = 'case' (CaseItem % ',') ('when' Expr)? | 'default' ;
CaseItem = Tern | Pattern | 'default' ;
Pattern = '_' | Modifier* Type Name | Type '(' (Pattern % ',')? ')' Name? ;
Expr = Tern | Post AOP Expr | Post '=' Expr | Post '>' '>=' Expr | Post '>' '>' '>=' Expr | Lambda ;
Lambda = Name '->' LambdaBody | '(' (Name % ',')? ')' '->' LambdaBody | '(' Formals ')' '->' LambdaBody ;
LambdaBody = Expr | Block ;
Tern = Bin | Bin '?' Expr ':' Expr ;
Bin = Unary | Bin BinOp Unary | Bin 'instanceof' Type | Bin 'instanceof' Pattern ;
BinOp = BOP | '+' | '-' | '<' | '>' | '>=' | '>' '>' | '>' '>' '>' | '&' | '|' | '*' ;
Unary = Post | ('+' | '-' | '!' | '~' | '++' | '--') Unary | '(' PRIMITIVE Dims? ')' Unary | '(' (Type % '&') ')' CastTo | Switch ;
CastTo = Post | ('!' | '~') Unary | Lambda | '(' PRIMITIVE Dims? ')' Unary | '(' (Type % '&') ')' CastTo | Switch ;
Post = Prim | Post '++' | Post '--' ;
Prim = Name | Literal | 'this' | 'super' | '(' Expr ')' | Prim '.' Name | Prim '.' 'this' | Prim '.' 'super' | Prim '.' 'class' | Prim '.' TArgs Name | Prim '.' TArgs 'super' | Prim '.' New | Prim Args | Prim '[' Expr ']' | New
  | PRIMITIVE Dims? '.' 'class' | 'void' '.' 'class' | Name Dims '.' 'class' | Prim Dims '.' 'class' | Prim '::' TArgs? (Name | 'new') | PRIMITIVE Dims '::' 'new' | Ref Dims '::' 'new' | Ref Dims '::' Name | Ref '::' TArgs? (Name | 'new') ;
Literal = NUM | STR | CHAR | 'true' | 'false' | 'null' ;
New = 'new' TArgs? Annotation* Ref Args ClassBody? | 'new' Annotation* Simple DimExpr+ Dims? | 'new' Annotation* Simple Dims '{' (Init (',' Init)* ','?)? '}' ;
DimExpr = Annotation* '[' Expr ']' ;
Args = '(' (Expr % ',')? ')' ;
Name = ID | '_' | 'record' | 'sealed' | 'permits' | 'yield' | 'module' | 'open' | 'requires' | 'exports' | 'opens' | 'uses' | 'provides' | 'with' | 'to' | 'transitive' | 'when' | 'non' ;
"""

GO = """
File = 'package' ID ';' (Import ';')* (Decl (';' Decl)* ';'?)? ;
Import = 'import' Spec | 'import' '(' (Spec (';' Spec)* ';'?)? ')' ;
Spec = (ID | '.')? STR ;
Decl = Func | VarDecl | ConstDecl | TypeDecl ;
VarDecl = 'var' VarSpec | 'var' '(' (VarSpec (';' VarSpec)* ';'?)? ')' ;
VarSpec = Ids Type ('=' Exprs)? | Ids '=' Exprs ;
ConstDecl = 'const' ConstSpec | 'const' '(' (ConstSpec (';' ConstSpec)* ';'?)? ')' ;
ConstSpec = Ids (Type? '=' Exprs)? ;
TypeDecl = 'type' TypeSpec | 'type' '(' (TypeSpec (';' TypeSpec)* ';'?)? ')' ;
TypeSpec = ID TypeParams? '='? Type ;
TypeParams = '[' (TypeParam % ',') ','? ']' ;
TypeParam = Ids Constraint ;
Constraint = ConstraintTerm % '|' ;
ConstraintTerm = '~'? Type ;
Func = 'func' ID TypeParams? Signature Block? | 'func' '(' Params? ')' ID Signature Block? ;
Signature = '(' Params? ')' Result? ;
Result = Type | '(' Params? ')' ;
Params = Param (',' Param)* ','? ;
Param = Type | ID Type | '...' Type | ID '...' Type ;
Ids = ID % ',' ;
Type = TypeName | '(' Type ')' | '[' Expr ']' Type | '[' '...' ']' Type | '[' ']' Type | '*' Type | 'map' '[' Type ']' Type | 'chan' Type | 'chan' '<-' Type | '<-' 'chan' Type | 'func' Signature | Struct | Interface ;
TypeName = ID | ID '.' ID | ID TypeArgs | ID '.' ID TypeArgs ;
TypeArgs = '[' (Type % ',') ','? ']' ;
Struct = 'struct' '{' (Field (';' Field)* ';'?)? '}' ;
Field = Ids Type STR? | '*'? TypeName STR? ;
Interface = 'interface' '{' (Elem (';' Elem)* ';'?)? '}' ;
Elem = ID Signature | Constraint ;
Block = '{' Stmts '}' ;
Stmts = Stmt? (';' Stmt?)* ;
Stmt = Decl | Simple | 'go' Expr | 'defer' Expr | 'return' Exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | Block | If | Switch | Select | For | ID ':' Stmt? ;
Simple = Expr | Expr '<-' Expr | Expr '++' | Expr '--' | Exprs AOP Exprs | Exprs '=' Exprs | Exprs ':=' Exprs ;
SimpleH = ExprH | ExprH '<-' ExprH | ExprH '++' | ExprH '--' | ExprsH AOP ExprsH | ExprsH '=' ExprsH | ExprsH ':=' ExprsH ;
If = 'if' (SimpleH? ';')? ExprH Block | 'if' (SimpleH? ';')? ExprH Block 'else' (If | Block) ;
Switch = 'switch' (SimpleH? ';')? SimpleH? '{' Clause* '}' | 'switch' (SimpleH? ';')? (ID ':=')? PrimH '.' '(' 'type' ')' '{' TypeClause* '}' ;
Clause = ('case' Exprs | 'default') ':' Stmts ;
TypeClause = ('case' (Type % ',') | 'default') ':' Stmts ;
Select = 'select' '{' SelectClause* '}' ;
SelectClause = ('case' Simple | 'default') ':' Stmts ;
For = 'for' Block | 'for' ExprH Block | 'for' SimpleH? ';' ExprH? ';' SimpleH? Block | 'for' ((ExprsH ('=' | ':='))? 'range' ExprH) Block ;
Exprs = Expr % ',' ;
ExprsH = ExprH % ',' ;
Expr = Unary | Expr BinOp Unary ;
ExprH = UnaryH | ExprH BinOp UnaryH ;
BinOp = BOP | '+' | '-' | '*' | '&' | '|' | '^' ;
UnOp = '+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~' ;
Unary = Prim | UnOp Unary ;
UnaryH = PrimH | UnOp UnaryH ;
Prim = PrimH | Prim Tail | Named Lit ;
PrimH = LitType Lit | ID | NUM | STR | CHAR | '(' Expr ')' | '(' TypeOnly ')' | 'func' Signature Block | PrimH Tail | TypeOnly '(' Expr ','? ')' ;
Named = ID | ID '.' ID | ID '[' (Type % ',') ','? ']' | ID '.' ID '[' (Type % ',') ','? ']' ;
TypeOnly = '[' Expr ']' Type | '[' '...' ']' Type | '[' ']' Type | 'map' '[' Type ']' Type | 'chan' Type | 'chan' '<-' Type | '<-' 'chan' Type | Struct | Interface | '*' TypeOnly | 'func' Signature ;
LitType = '[' Expr ']' Type | '[' '...' ']' Type | '[' ']' Type | 'map' '[' Type ']' Type | Struct ;
Tail = '.' ID | '.' '(' Type ')' | '.' '(' 'type' ')' | '[' Index ']' | '(' (Arg (',' Arg)* '...'? ','?)? ')' ;
Index = Expr | Expr? ':' Expr? | Expr? ':' Expr ':' Expr | (TypeOnly | Expr) (',' (TypeOnly | Expr))+ ','? | TypeOnly ;
Arg = Expr | TypeOnly ;
Lit = '{' (KeyedItem (',' KeyedItem)* ','?)? '}' ;
KeyedItem = Value | Value ':' Value ;
Value = Expr | Lit ;
"""


def _rust_expressions(s: str, structs: bool, blocks: bool) -> str:
    r = "N" if s == "N" else ""  # what may follow the leftmost operand
    return f"""
Expr{s} = Range{s} | Un{s} AOP Expr{r} | Un{s} '=' Expr{r} | Un{s} '>' '>=' Expr{r} | Jump{r} ;
Range{s} = Bin{s} | Bin{s} '..' | Bin{s} '..' Bin{r} | Bin{s} '..=' Bin{r} | '..' | '..' Bin{r} | '..=' Bin{r} ;
Bin{s} = Un{s} | Bin{s} BinOp Un{r} | Bin{s} 'as' TypeNB | Bin{s} BinOp Jump{r} ;
Un{s} = Post{s} | ('-' | '!' | '*') Un{r} | ('&' | '&&') 'raw'? ('mut' | 'const')? Un{r} | 'let' Pattern '=' Un{r} ;
Post{s} = Prim{s} | Post{s} '?' | Post{s} '.' Field Generic? | Post{s} '.' NUM | Post{s} '.' 'await' | Post{s} '(' Args? ')' | Post{s} '[' Expr ']' {"" if blocks else "| Blocky '?' | Blocky '.' Field Generic? | Blocky '.' 'await'"} ;
Prim{s} = Literal | EPath | '(' ')' | '(' Expr ')' | '(' Expr ',' (Expr (',' Expr)* ','?)? ')' | '[' (Expr (',' Expr)* ','?)? ']' | '[' Expr ';' Expr ']' | MacroCall
  {"| EPath '{' StructFields? '}'" if structs else ""} {"| Blocky" if blocks else ""} ;
"""


RUST = (
    """
Crate = InnerAttr* Item* ;
InnerAttr = '#' '!' '[' Tree* ']' ;
Attr = '#' '[' Tree* ']' ;
Tree = @ALL | '(' Tree* ')' | '[' Tree* ']' | '{' Tree* '}' ;
Vis = 'pub' | 'pub' '(' ('crate' | 'self' | 'super' | 'in' SPath) ')' ;
Item = Attr* Vis? Bare | Attr* MacroItem ;
MacroItem = SPath '!' ID? '(' Tree* ')' ';' | SPath '!' ID? '[' Tree* ']' ';' | SPath '!' ID? '{' Tree* '}' | 'macro_rules' '!' ID '{' Tree* '}' | 'macro_rules' '!' ID '(' Tree* ')' ';' ;
Bare = 'use' UseTree ';' | 'mod' ID ';' | 'mod' ID '{' InnerAttr* Item* '}' | 'extern' 'crate' (ID | 'self') ('as' ID)? ';' | Fn | 'type' ID Generics? (':' Bounds?)? Where? ('=' Type)? Where? ';'
  | 'struct' ID Generics? Where? (FieldDecls | ';') | 'struct' ID Generics? '(' TupleDecls? ')' Where? ';' | ('union' ID Generics? Where? FieldDecls) | 'enum' ID Generics? Where? '{' (Variant (',' Variant)* ','?)? '}'
  | 'const' (ID | '_') ':' Type ('=' Expr)? ';' | 'static' 'mut'? ID ':' Type ('=' Expr)? ';'
  | 'unsafe'? 'auto'? 'trait' ID Generics? (':' Bounds?)? Where? '{' InnerAttr* Item* '}' | 'default'? 'unsafe'? 'impl' Generics? 'const'? '!'? Type ('for' Type)? Where? '{' InnerAttr* Item* '}' | 'unsafe'? 'extern' STR? '{' InnerAttr* Item* '}' ;
Fn = FnMod* 'fn' ID Generics? '(' Params? ')' ('->' Type)? Where? (Block | ';') ;
FnMod = 'const' | 'async' | 'unsafe' | 'extern' STR? | 'default' ;
Params = Param (',' Param)* ','? ;
Param = Attr* Pattern ':' Type | Attr* ('&' LIFE?)? 'mut'? 'self' (':' Type)? | Attr* '...' ;
UseTree = SPath ('as' (ID | '_'))? | (SPath? '::')? '*' | (SPath? '::')? '{' (UseTree (',' UseTree)* ','?)? '}' ;
SPath = '::'? (Seg % '::') ;
Seg = ID | 'self' | 'super' | 'crate' | 'Self' | '$' 'crate' | 'union' | 'auto' | 'default' | 'raw' | 'macro_rules' ;
FieldDecls = '{' (FieldDecl (',' FieldDecl)* ','?)? '}' ;
FieldDecl = Attr* Vis? Field ':' Type ('=' Expr)? ;
TupleDecls = TupleDecl (',' TupleDecl)* ','? ;
TupleDecl = Attr* Vis? Type ;
Variant = Attr* Vis? ID (FieldDecls | '(' TupleDecls? ')')? ('=' Expr)? ;
Generics = '<' (GParam (',' GParam)* ','?)? '>' ;
GParam = Attr* LIFE (':' (LIFE % '+')?)? | Attr* ID (':' Bounds?)? ('=' Type)? | Attr* 'const' ID ':' Type ('=' (Literal | '-' Literal | Block | ID))? ;
Where = 'where' (Pred (',' Pred)* ','?)? ;
Pred = LIFE ':' (LIFE % '+')? | ForLife? Type ':' Bounds? ;
ForLife = 'for' Generics ;
Bounds = Bound ('+' Bound)* '+'? ;
Bound = LIFE | ('?' | '~' 'const')? ForLife? TPath | '(' ('?')? ForLife? TPath ')' | 'use' '<' (TArg % ',')? '>' ;
Type = TypeNB | 'impl' Bounds | 'dyn' Bounds | ForLife? TPath ('+' Bound)+ ;
TypeNB = TPath | '(' ')' | '(' Type ')' | '(' Type ',' (Type (',' Type)* ','?)? ')' | '!' | '&' LIFE? 'mut'? TypeRef | '&&' LIFE? 'mut'? TypeRef | '*' ('const' | 'mut') TypeRef | '[' Type ']' | '[' Type ';' Expr ']' | '_' | FnType | MacroCall | ForLife FnType | ForLife TPath ;
TypeRef = TypeNB | 'dyn' Bound | 'impl' Bound ;
FnType = ('unsafe' | 'extern' STR?)* 'fn' '(' (FnArg (',' FnArg)* ','?)? ')' ('->' TypeNB)? ;
FnArg = Type | (ID | '_') ':' Type | '...' ;
TPath = '::'? (TSeg % '::') | '<' Type ('as' TPath)? '>' ('::' TSeg)+ ;
TSeg = Seg | Seg '::'? TArgs | Seg '(' (Type (',' Type)* ','?)? ')' ('->' TypeNB)? ;
TArgs = '<' (TArg (',' TArg)* ','?)? '>' ;
TArg = Type | LIFE | Literal | '-' Literal | Block | ID TArgs? '=' Type | ID TArgs? ':' Bounds ;
Generic = '::' TArgs ;
EPath = '::'? ESegs | '<' Type ('as' TPath)? '>' ('::' Seg Generic?)+ ;
ESegs = Seg Generic? | ESegs '::' Seg Generic? ;
Field = ID | 'union' | 'auto' | 'default' | 'raw' | 'macro_rules' ;
Block = '{' InnerAttr* Stmt* Expr? '}' | '{' InnerAttr* Stmt* Attr+ Expr '}' ;
Stmt = ';' | Item | Attr* 'let' Pattern (':' Type)? ('=' Expr)? ('else' Block)? ';' | Attr* ExprT ';' | Attr* Blocky | Attr* Blocky ';' | MacroStmt ;
MacroStmt = SPath '!' '{' Tree* '}' ;
Blocky = Label? Block | 'unsafe' Block | 'async' 'move'? Block | 'const' Block | If | Match | Label? 'loop' Block | Label? 'while' ExprN Block | Label? 'for' Pattern 'in' ExprN Block ;
Label = LIFE ':' ;
If = 'if' ExprN Block | 'if' ExprN Block 'else' (Block | If) ;
Match = 'match' ExprN '{' InnerAttr* Arms? '}' ;
Arms = Arm* LastArm ;
Arm = Attr* '|'? Pattern ('if' Expr)? '=>' (Expr ',' | Blocky ','?) ;
LastArm = Attr* '|'? Pattern ('if' Expr)? '=>' Expr ','? ;
Jump = 'return' Expr? | 'break' LIFE? Expr? | 'continue' LIFE? | Closure | 'yield' Expr? ;
JumpN = 'return' ExprN? | 'break' LIFE? ExprN? | 'continue' LIFE? | ClosureN ;
Closure = ClosureHead Expr | ClosureHead '->' TypeNB Block ;
ClosureN = ClosureHead ExprN | ClosureHead '->' TypeNB Block ;
ClosureHead = ('static' | 'async' | 'move')* ('||' | '|' (CParam (',' CParam)* ','?)? '|') ;
CParam = Attr* PatternNT (':' Type)? ;
Pattern = '|'? (PatternNT % '|') ;
PatternNT = ('ref')? 'mut'? ID ('@' PatternNT)? | Literal | '-' NUM | PatEnd ('..=' | '..' | '...') PatEnd? | ('..=' | '..') PatEnd | '..' | '_' | ('&' | '&&') 'mut'? PatternNT | EPath | EPath '(' (Pattern (',' Pattern)* ','?)? ')' | EPath '{' (FieldPat (',' FieldPat)* ','?)? '}'
  | '(' (Pattern (',' Pattern)* ','?)? ')' | '[' (Pattern (',' Pattern)* ','?)? ']' | MacroCall | 'const' Block | 'box' PatternNT ;
PatEnd = Literal | '-' NUM | EPath ;
FieldPat = Attr* (Field | NUM) ':' Pattern | Attr* 'ref'? 'mut'? Field | Attr* '..' ;
MacroCall = SPath '!' ('(' Tree* ')' | '[' Tree* ']' | '{' Tree* '}') ;
Args = Expr (',' Expr)* ','? ;
StructFields = StructField (',' StructField)* ','? | StructField (',' StructField)* ',' '..' Expr? | '..' Expr ;
StructField = Attr* (Field | NUM) ':' Expr | Attr* Field ;
Literal = NUM | STR | CHAR | 'true' | 'false' ;
BinOp = BOP | '+' | '-' | '*' | '&' | '&&' | '|' | '||' | '<' | '>' | '>=' | '>' '>' ;
"""
    + _rust_expressions("", True, True)
    + _rust_expressions("N", False, True)
    + _rust_expressions("T", True, False)
)


def _any_token(text: str) -> str:
    """``@ALL``: every terminal of the grammar but brackets, and the marks only macros use."""
    import re

    literals = set(re.findall(r"'([^']+)'", text)) | {";", ",", "$", "~", "@", "#", "?", "^"}
    return text.replace("@ALL", " | ".join([*(f"'{x}'" for x in sorted(literals) if x not in "()[]{}"), "ID", "NUM", "STR", "CHAR", "LIFE", "BOP", "AOP"]))


RUST = _any_token(RUST)

GRAMMARS = {
    "python": PYTHON, "java": JAVA, "javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "go": GO, "rust": RUST,
    "json": JSON, "toml": TOML, "xml": XML, "yaml": YAML,
}
