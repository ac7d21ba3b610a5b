"""Grammars of the supported languages, in the notation of gll.Grammar.

They take every program of the language but for the limits that the README lists, and
no more than a syntax check needs: assignment targets, duplicate modifiers and the
like are not checked.  Rules marked @ are those that extraction reads.
"""

from __future__ import annotations

from .gll import AUTO_SEMI, Grammar

# In "X" rules (loop and condition heads) a brace cannot open a literal.
_GO_EXPR = """
ExprList§ = Expr§ {',' Expr§} ;
Expr§ = Unary§ { (BIN | '+' | '-' | '*' | '&' | '^' | '<-' ) Unary§ } ;
Unary§ = {'+' | '-' | '*' | '&' | '^' | '!' | '<-' | '~'} Primary§ ;
Primary§ = Operand§ { '.' (ID | '(' ('type' | Type) ')') | '[' Index ']' | '(' [Args] ')' $ } ;
Operand§ = ID | NUM | STR | '(' Type0 ')' | LitType [ LitValue ] | FuncLit ;
Simple§ = ExprList§ [ (':=' | '=' | ASG) (ExprList§ | 'range' Expr§) | '++' | '--' ] | 'range' Expr§ ;
"""

GO = (
    """
File = {';'} 'package' ID ';' { [Import] ';' } { [TopDecl] ';' } ;
Import = 'import' ( ImportSpec | '(' [ImportSpec] { ';' [ImportSpec] } ')' ) ;
ImportSpec = [ID | '.'] STR ;
TopDecl = FuncDecl | VarDecl | ConstDecl | TypeDecl ;
@FuncDecl = 'func' [Receiver] ID [TypeParams] Signature [Block] ;
@Receiver = '(' [ParamList] ')' ;
Signature = Params [Result] ;
Result = '(' [ParamList] ')' | TypeNoParen ;
Params = '(' [ParamList] ')' ;
ParamList = Param {',' Param} [','] ;
Param = ID [ ['...'] TypeNoName | '...' ID ['.' ID] | ID ['.' ID] [TypeArgs] | '.' ID [TypeArgs] | TypeArgs ] | ['...'] TypeNoName | '...' ID ['.' ID] ;
TypeArgs = '[' Type {',' Type} [','] ']' ;
Type = ID ['.' ID] [TypeArgs] | TypeNoName ;
TypeNoParen = ID ['.' ID] [TypeArgs] | TypeLit ;
TypeNoName = TypeLit | '(' Type ')' ;
Type0 = Expr ;
TypeLit = '*' Type | LitType | 'chan' ['<-'] Type | '<-' 'chan' Type | 'func' Signature | 'interface' '{' [Elem] {';' [Elem]} '}' ;
LitType = '[' [Expr | '...'] ']' Type | 'map' '[' Type ']' Type | 'struct' '{' [Field] {';' [Field]} '}' | 'chan' Type | 'interface' '{' [Elem] {';' [Elem]} '}' ;
Elem = ID [ '.' ID | Signature ] { '|' ['~'] Type } | '~' Type {'|' ['~'] Type} | TypeLit {'|' ['~'] Type} ;
Field = ID [ {',' ID} Type | '.' ID ] [STR] | '*' ID ['.' ID] [STR] ;
TypeParams = '[' ID {',' ID} Constraint {',' ID {',' ID} Constraint} [','] ']' ;
Constraint = ['~'] Type {'|' ['~'] Type} ;
VarDecl = 'var' ( VarSpec | '(' [VarSpec] {';' [VarSpec]} ')' ) ;
VarSpec = ID {',' ID} ( Type ['=' ExprList] | '=' ExprList ) ;
ConstDecl = 'const' ( ConstSpec | '(' [ConstSpec] {';' [ConstSpec]} ')' ) ;
ConstSpec = ID {',' ID} [ [Type] '=' ExprList ] ;
TypeDecl = 'type' ( TypeSpec | '(' [TypeSpec] {';' [TypeSpec]} ')' ) ;
@TypeSpec = ID [TypeParams] ['='] Type ;
Block = '{' Stmts '}' ;
Stmts = [Stmt] {';' [Stmt]} ;
Stmt = VarDecl | ConstDecl | TypeDecl | Simple [':' [Stmt]] | 'go' Expr | 'defer' Expr | 'return' [ExprList] | 'break' [ID] | 'continue' [ID] | 'goto' ID | 'fallthrough' | Block | If | For | Switch | Select ;
If = 'if' [SimpleX] [';' SimpleX] Block ['else' (If | Block)] ;
For = 'for' [ SimpleX ] [ ';' [SimpleX] ';' [SimpleX] ] Block ;
Switch = 'switch' [SimpleX] [';' [SimpleX]] '{' { Case ':' Stmts } '}' ;
Case = 'case' CaseItem {',' CaseItem} | 'default' ;
CaseItem = Expr | 'func' Signature ;
Select = 'select' '{' { ('case' Simple | 'default') ':' Stmts } '}' ;
FuncLit = 'func' Signature [Block] ;
Args = Arg {',' Arg} [','] ;
Arg = Expr ['...'] ;
Index = [Expr] [ ':' [Expr] [':' Expr] | {',' Type} [','] ] ;
LitValue = '{' [ LitElem {',' LitElem} [','] ] '}' ;
LitElem = (Expr | LitValue) [':' (Expr | LitValue)] ;
"""
    + _GO_EXPR.replace("§", "").replace("$", "| LitValue")
    + _GO_EXPR.replace("§", "X").replace("$", "")
)

PYTHON = """
File = { NL | Stmt } ;
Stmt = Simples | If | While | For | Try | With | Def | Class | Decorated | 'async' (Def | For | With) | Match ;
Simples = Simple {';' Simple} [';'] NL ;
Suite = NL INDENT Stmt {Stmt} DEDENT | Simples ;
Simple = Expression | 'return' [Exprs] | 'raise' [Expr ['from' Expr]] | 'global' Name {',' Name} | 'nonlocal' Name {',' Name}
  | 'pass' | 'break' | 'continue' | 'del' Exprs | 'assert' Expr [',' Expr] | 'import' Dotted ['as' Name] {',' Dotted ['as' Name]}
  | 'from' ( ('.' | '...') {'.' | '...'} [Dotted] | Dotted ) 'import' ( '*' | '(' ImportAs {',' ImportAs} [','] ')' | ImportAs {',' ImportAs} ) | TypeAlias ;
ImportAs = Name ['as' Name] ;
TypeAlias = 'type' Name [TypeParams] '=' Expr ;
TypeParams = '[' TypeParam {',' TypeParam} [','] ']' ;
TypeParam = ['*' | '**'] Name [':' Expr] ['=' Expr] ;
Dotted = Name {'.' Name} ;
Name = ID | 'match' | 'case' | 'type' ;
Expression = Exprs [ ':' Expr ['=' Value] | ASG Value | '=' Value {'=' Value} ] | Yield ;
Value = Yield | Exprs ;
Yield = 'yield' [ 'from' Expr | Exprs ] ;
Exprs = Star {',' Star} [','] ;
Star = '*' Bin | Named ;
Named = Expr [':=' Expr] ;
Expr = Lambda | Bin ['if' Bin 'else' Expr] ;
Lambda = 'lambda' [LParams] ':' Expr ;
LParams = LParam {',' LParam} [','] ;
LParam = Name ['=' Expr] | '*' [Name] | '**' Name | '/' ;
Bin = Unary { (BIN | '-' | '*' | '**' | '@' | '/' | 'in' | 'not' 'in' | 'is' ['not']) Unary } ;
Unary = {'-' | '+' | '~' | 'not' | 'await'} Primary ;
Primary = Atom { '.' Name | '(' [Args] ')' | '[' Subs ']' } ;
Atom = Name | NUM | STR {STR} | '...' | 'None' | 'True' | 'False' | '(' [ Yield | Comp ] ')' | '[' [Comp] ']' | '{' [DictSet] '}' ;
Comp = Star ( CompFor | {',' Star} [','] ) ;
DictSet = DictItem ( CompFor | {',' DictItem} [','] ) ;
DictItem = '**' Bin | '*' Bin | Named [':' Expr] ;
CompFor = ['async'] 'for' Targets 'in' Bin { 'if' CompIf } [CompFor] ;
CompIf = Bin [':=' Bin] | Lambda ;
Targets = Target {',' Target} [','] ;
Target = ['*'] Primary ;
Args = Arg {',' Arg} [','] ;
Arg = '*' Expr | '**' Expr | Named [ '=' Expr | CompFor ] ;
Subs = Sub {',' Sub} [','] ;
Sub = '*' Bin | Named [ ':' [Expr] [':' [Expr]] ] | ':' [Expr] [':' [Expr]] ;
Params = Param {',' Param} [','] ;
Param = Name [':' Expr] ['=' Expr] | '*' [Name [':' ['*'] Expr]] | '**' Name [':' Expr] | '/' ;
@Def = 'def' Name [TypeParams] '(' [Params] ')' ['->' Expr] ':' Suite ;
@Class = 'class' Name [TypeParams] ['(' [Args] ')'] ':' Suite ;
@Decorated = '@' Named NL {'@' Named NL} ( ['async'] Def | Class ) ;
If = 'if' Named ':' Suite {'elif' Named ':' Suite} ['else' ':' Suite] ;
While = 'while' Named ':' Suite ['else' ':' Suite] ;
For = 'for' Targets 'in' Exprs ':' Suite ['else' ':' Suite] ;
Try = 'try' ':' Suite ( Except {Except} ['else' ':' Suite] ['finally' ':' Suite] | 'finally' ':' Suite ) ;
Except = 'except' ['*'] [Expr {',' Expr} ['as' Name]] ':' Suite ;
With = 'with' ( WithItem {',' WithItem} | '(' WithItem {',' WithItem} [','] ')' ) ':' Suite ;
WithItem = Expr ['as' ( Target | '(' Targets ')' ) ] ;
Match = 'match' Exprs ':' NL INDENT CaseBlock {CaseBlock} DEDENT ;
CaseBlock = 'case' Pattern {',' Pattern} [','] ['if' Named] ':' Suite ;
Pattern = ['*'] Bin ['as' Name] ;
"""

# <...> marks what only TypeScript has.
_JS = """
Program = {Item} ;
Item = Stmt | Import | Export ;
Semi = ';' | ASI ;
Import = 'import' ( STR [ImportAttrs] Semi | <['type']> ImportClause 'from' STR [ImportAttrs] Semi | ImportTail Semi <| Name '=' Expr Semi> ) ;
ImportAttrs = 'with' Object ;
ImportTail = ( '(' Assign [','] ')' | '.' AnyName ) { Suffix } { BinOp Unary } ;
ImportClause = Name [',' (Named | '*' 'as' Name)] | Named | '*' 'as' Name ;
Named = '{' [ Spec {',' Spec} [','] ] '}' ;
Spec = <['type']> (AnyName | STR) ['as' (AnyName | STR)] ;
@Export = 'export' ( Declared | 'default' ( Func | Class | DefaultExpr Semi <| Interface> ) | ExportFrom Semi <| '=' Expr Semi | 'as' 'namespace' Name Semi> ) ;
DefaultExpr = Assign ;
ExportFrom = <['type']> ( '*' ['as' (AnyName | STR)] 'from' STR [ImportAttrs] | Named ['from' STR [ImportAttrs]] ) ;
Declared = VarStmt | Func | Class <| TsDecl> ;
Block = '{' {Stmt} '}' ;
Stmt = Block | VarStmt | Func | Class | If | For | While | Do | 'return' [Expr] Semi | ('break' | 'continue') [Name] Semi | 'throw' Expr Semi | Try | Switch | ';' | 'debugger' Semi | ExprStmt <| TsDecl> ;
ExprStmt = Expr ( Semi | ':' Stmt ) ;
VarStmt = 'const' ( VarDecl {',' VarDecl} Semi <| Enum> ) | ('let' | 'var') VarDecl {',' VarDecl} Semi ;
@VarDecl = Binding <['!'] [':' Type]> [Init] ;
@Init = '=' Assign ;
Binding = Name | '{' [ BindProp {',' BindProp} [','] ] '}' | '[' {','} [ BindElem {',' [BindElem]} ] ']' ;
BindProp = '...' Binding | PropName [':' Binding] ['=' Assign] ;
BindElem = ['...'] Binding ['=' Assign] ;
@Func = [ASYNCF] 'function' ['*'] [Name] <[TypeParams]> Params <[':' Type]> FuncEnd ;
FuncEnd = Block < | Semi > ;
Params = '(' [ Param {',' Param} [','] ] ')' ;
Param = <{Decorator} {ParamMod}> ['...'] Binding <['?'] [':' Type]> ['=' Assign] ;
@Class = {Decorator} <['abstract']> 'class' [Name] <[TypeParams]> ['extends' Unary <[TypeArgs]>] <['implements' TypeList]> '{' {Member} '}' ;
Decorator = '@' ( Name {'.' AnyName} [Paren] | Paren ) ;
Member = ';' | {Decorator} {MemberMod} ['*'] PropName <['?' | '!']> (Method | Field) | 'static' Block < | {MemberMod} '[' Name ':' Type ']' ':' Type Semi > ;
MemberMod = 'static' | 'async' | 'get' | 'set' < | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' > ;
@Method = <[TypeParams]> Params <[':' Type]> FuncEnd ;
Field = <[':' Type]> ['=' Assign] Semi ;
If = 'if' '(' Expr ')' Stmt ['else' Stmt] ;
For = 'for' ['await'] '(' ForHead ')' Stmt ;
ForHead = ('const' | 'let' | 'var') Binding <[':' Type]> ( ('of' | 'in') Expr | ['=' Assign] {',' VarDecl} ForRest ) | Expr [ 'of' Expr | ForRest ] | ForRest ;
ForRest = ';' [Expr] ';' [Expr] ;
While = 'while' '(' Expr ')' Stmt ;
Do = 'do' Stmt 'while' '(' Expr ')' [';'] ;
Try = 'try' Block ( 'catch' ['(' Binding <[':' Type]> ')'] Block ['finally' Block] | 'finally' Block ) ;
Switch = 'switch' '(' Expr ')' '{' { ('case' Expr | 'default') ':' {Stmt} } '}' ;
Expr = Assign {',' Assign} ;
Assign = Bin [ (ASG | '=') Assign | '?' Assign ':' Assign ] | 'yield' ['*'] [Assign] ;
@ArrowTail = '=>' ArrowBody ;
ArrowBody = Block | Assign ;
Bin = Unary { BinOp Unary < | ('as' | 'satisfies') ( Type | 'const' ) > } ;
BinOp = BIN | '+' | '-' | '*' | '/' | '&' | '|' | '<' | '>' ['>' ['>']] | '>=' | 'in' | 'instanceof' ;
Unary = {'+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await'} Lhs ['++' | '--'] < | TypeParams Unary > ;
Lhs = Primary { Suffix } ;
Suffix = '.' AnyName | '?.' ( AnyName | Paren | '[' Expr ']' | STR ) | '[' Expr ']' | Paren | STR < | '!' | TypeArgs (Paren | STR) > ;
Primary = Name [ArrowTail] | 'async' ( Name ArrowTail | <[TypeParams]> Paren ( ArrowTail <| ':' Type ArrowTail> ) ) | NUM | STR | 'this' | 'super' | 'null' | 'true' | 'false' | Paren [ ArrowTail <| ':' Type ArrowTail> ] | Array | Object | FuncExpr | Class | 'new' ( Lhs | '.' AnyName ) | 'import' ( Paren | '.' AnyName ) ;
@FuncExpr = [ASYNCF] 'function' ['*'] [Name] <[TypeParams]> Params <[':' Type]> Block ;
Paren = '(' [ ParenItem {',' [ParenItem]} ] ')' ;
ParenItem = '...' Assign <[':' Type]> | Expr1 ;
Expr1 = Assign < ['?'] [':' Type] ['=' Assign] > ;
Array = '[' {','} [ ArrayItem {',' [ArrayItem]} ] ']' ;
ArrayItem = ['...'] Assign ;
Object = '{' [ Prop {',' Prop} [','] ] '}' ;
Prop = '...' Assign | {'async' | 'get' | 'set'} ['*'] PropName ( ':' Assign | Method1 | ['=' Assign] ) ;
Method1 = <[TypeParams]> Params <[':' Type]> Block ;
PropName = AnyName | STR | NUM | '[' Assign ']' ;
Name = ID | CONTEXT ;
AnyName = Name | WORD ;
"""

_TS = """
TsDecl = Interface | TypeAlias | Enum | Namespace | 'declare' ( Declared | 'global' Block ) ;
@Interface = 'interface' Name [TypeParams] ['extends' TypeList] ObjType ;
@TypeAlias = 'type' Name [TypeParams] '=' Type Semi ;
@Enum = 'enum' Name '{' [ EnumItem {',' EnumItem} [','] ] '}' ;
EnumItem = PropName ['=' Assign] ;
Namespace = ('namespace' | 'module') ( Name {'.' Name} | STR ) ( '{' {Item} '}' | Semi ) ;
ParamMod = 'public' | 'private' | 'protected' | 'readonly' | 'override' ;
TypeParams = '<' TypeParam {',' TypeParam} [','] '>' ;
TypeParam = ['const'] ['in'] Name ['extends' Type] ['=' Type] ;
TypeArgs = '<' Type {',' Type} [','] '>' ;
TypeList = Type {',' Type} ;
Type = Union ['extends' Union '?' Type ':' Type] | FuncType ;
FuncType = [TypeParams] Params '=>' Type | ['abstract'] 'new' [TypeParams] Params '=>' Type ;
Union = ['|'] Inter {'|' Inter} ;
Inter = ['&'] TypeOp {'&' TypeOp} ;
TypeOp = ('keyof' | 'unique' | 'readonly' | 'infer') TypeOp | Postfix ;
Postfix = PrimType { '[' [Type] ']' } ;
PrimType = Name {'.' AnyName} [TypeArgs | 'is' Type] | 'this' ['is' Type] | STR | NUM | '-' NUM | 'null' | 'void' | 'true' | 'false' | 'asserts' (Name | 'this') ['is' Type] | 'typeof' ( Name | 'this' | 'import' '(' Type ')' ) {'.' AnyName} [TypeArgs]
  | ObjType | '[' [ TupleItem {',' TupleItem} [','] ] ']' | '(' Type ')' | 'import' '(' Type ')' {'.' AnyName} [TypeArgs] ;
TupleItem = ['...'] ( Type ['?'] | Name ['?'] ':' Type ) ;
ObjType = '{' [TypeMember] { (';' | ',' | ASI) [TypeMember] } '}' ;
TypeMember = {'readonly' | 'get' | 'set'} PropName ['?'] ( [':' Type] | [TypeParams] Params [':' Type] ) | [TypeParams] Params [':' Type] | 'new' [TypeParams] Params [':' Type]
  | ['+' | '-'] ['readonly'] '[' Name ( ':' Type ']' | 'in' Type ['as' Type] ']' ) [['+' | '-'] '?'] [':' Type] ;
"""

# What the grammar of TypeScript has besides in files with JSX.
_JSX = """
Jsx = JOPEN [JNAME] {JsxAttr} ( JEND | JGT {JsxChild} JCLOSE ) ;
JsxAttr = JNAME ['=' ( STR | '{' Assign '}' | Jsx )] | '{' '...' Assign '}' ;
JsxChild = Jsx | '{' [ ['...'] Expr ] '}' ;
"""

# Block-like expressions end a statement by themselves; in "X" rules a brace opens no literal.
_RUST_EXPR = """
Expr~ = Bin~ { ('..' | '..=') [Bin~] } | ('..' | '..=') [Bin~] ;
Bin~ = Unary~ { (BIN | '+' | '-' | '*' | '&' | '|' | '&&' | '||' | '=' | '<' | '>' ['>'] | '>=') Unary~ | 'as' TypeNoBound } ;
Unary~ = { '-' | '*' | '!' | '&' ['mut'] | '&&' ['mut'] $ } ( Primary~ { Suffix } | Jump~ | Closure~ ) ;
Jump~ = 'return' [Expr~] | 'break' [LIFE] [Expr~] | 'continue' [LIFE] | 'yield' [Expr~] ;
Closure~ = ['static'] ['async'] ['move'] ( '|' [ClosureParam {',' ClosureParam} [',']] '|' | '||' ) ( '->' TypeNoBound Block | Expr~ ) ;
"""

RUST = (
    """
File = {InnerAttr} {Item} ;
InnerAttr = '#' '!' '[' {Tree} ']' ;
Attr = '#' '[' {Tree} ']' ;
Item = {Attr} [Vis] ( Fn | Struct | Enum | Union | Trait | Impl | TypeAlias | Const | Static | Use | Mod | Extern | MacroItem ) ;
Vis = 'pub' [ '(' ('crate' | 'self' | 'super' | 'in' Path) ')' ] ;
@Fn = {'const' | 'async' | 'unsafe' | 'extern' [STR]} 'fn' ID [Generics] '(' [ FnParam {',' FnParam} [','] ] ')' ['->' Type] [Where] (Block | ';') ;
FnParam = {Attr} ( Pat [':' Type] | '...' ) ;
@Struct = 'struct' ID [Generics] ( ';' | '(' [ TupleField {',' TupleField} [','] ] ')' [Where] ';' | [Where] Fields ) ;
TupleField = {Attr} [Vis] Type ;
Fields = '{' [ Field {',' Field} [','] ] '}' ;
Field = {Attr} [Vis] ID ':' Type ;
@Enum = 'enum' ID [Generics] [Where] '{' [ Variant {',' Variant} [','] ] '}' ;
Variant = {Attr} [Vis] ID [ Fields | '(' [ TupleField {',' TupleField} [','] ] ')' ] ['=' Expr] ;
Union = UNIONWORD ID [Generics] [Where] Fields ;
@Trait = ['unsafe'] 'trait' ID [Generics] [':' [Bounds]] [Where] '{' {InnerAttr} {Assoc} '}' ;
@Impl = ['unsafe'] 'impl' [Generics] ['!'] Type ['for' Type] [Where] '{' {InnerAttr} {Assoc} '}' ;
Assoc = {Attr} [Vis] ( Fn | TypeAlias | Const | MacroItem ) ;
@TypeAlias = 'type' ID [Generics] [':' [Bounds]] [Where] ['=' Type] [Where] ';' ;
@Const = 'const' (ID | '_') ':' Type ['=' Expr] ';' ;
Static = 'static' ['mut'] ID ':' Type ['=' Expr] ';' ;
Use = 'use' UseTree ';' ;
UseTree = ['::'] ( UseSeg {'::' UseSeg} ['as' (ID | '_')] ) ;
UseSeg = ID | 'self' | 'super' | 'crate' | 'Self' | '*' | '{' [ UseTree {',' UseTree} [','] ] '}' ;
Mod = 'mod' ID ( ';' | '{' {InnerAttr} {Item} '}' ) ;
Extern = 'extern' ( 'crate' (ID | 'self') ['as' (ID | '_')] ';' | [STR] '{' {InnerAttr} {ExternItem} '}' ) ;
ExternItem = {Attr} [Vis] ( Fn | Static | TypeAlias ) ;
MacroItem = Path '!' [ID] ( '{' {Tree} '}' | '(' {Tree} ')' ';' | '[' {Tree} ']' ';' ) ;
Tree = ANYTOKEN | '(' {Tree} ')' | '[' {Tree} ']' | '{' {Tree} '}' ;
Generics = '<' [ Generic {',' Generic} [','] ] '>' ;
Generic = {Attr} ( LIFE [':' [LIFE {'+' LIFE}]] | ID [':' [Bounds]] ['=' Type] | 'const' ID ':' Type ['=' (NUM | STR | ID | Block)] ) ;
Where = 'where' [ Pred {',' Pred} [','] ] ;
Pred = LIFE ':' [LIFE {'+' LIFE}] | ['for' Generics] Type ':' [Bounds] ;
Bounds = Bound {'+' Bound} ;
Bound = LIFE | ['?' | '~' 'const'] ['for' Generics] Path | '(' ['?'] ['for' Generics] Path ')' ;
Type = TypeNoBound {'+' Bound} ;
TypeNoBound = ('&' | '&&') [LIFE] ['mut'] TypeNoBound | '*' ('const' | 'mut') TypeNoBound | '[' Type [';' Expr] ']' | '(' [ Type {',' Type} [','] ] ')' | '!' | '_' | ('impl' | 'dyn') Bound
  | ['for' Generics] {'unsafe' | 'extern' [STR]} 'fn' '(' [ FnTypeParam {',' FnTypeParam} [','] ] ')' ['->' TypeNoBound] | Path ['!' '(' {Tree} ')'] | QPath ;
FnTypeParam = Type [':' Type] | '...' ;
QPath = '<' Type ['as' Path] '>' '::' Seg {'::' Seg} ;
Path = ['::'] Seg {'::' (Seg | GenericArgs)} ;
Seg = SegName [ GenericArgs | '(' [ Type {',' Type} [','] ] ')' ['->' TypeNoBound] ] ;
SegName = ID | 'self' | 'Self' | 'super' | 'crate' ;
GenericArgs = '<' [ GenericArg {',' GenericArg} [','] ] '>' ;
GenericArg = LIFE | Type ['=' Type | ':' Bounds] | ['-'] NUM | STR | 'true' | 'false' | Block ;
Block = '{' {InnerAttr} Body '}' ;
Body = { ';' | Let | {Attr} ( Inner | Expr ';' | BlockLike { Suffix } ) } [ {Attr} Expr ] ;
Inner = [Vis] ( Fn | Struct | Enum | Trait | Impl | TypeAlias | Const | Static | Use | Mod | Extern ) ;
Let = {Attr} 'let' Pats [':' Type] ['=' Expr ['else' Block]] ';' ;
BlockLike = Block | 'unsafe' Block | 'async' ['move'] Block | 'const' Block | [LIFE ':'] ( 'loop' Block | 'while' ExprX Block | 'for' Pats 'in' ExprX Block | Block ) | If | Match ;
If = 'if' ExprX Block ['else' (If | Block)] ;
Match = 'match' ExprX '{' {InnerAttr} Arms '}' ;
Arms = { ArmHead ( Expr ',' | BlockLike {Suffix} [','] ) } [ ArmHead Expr ] ;
ArmHead = {Attr} Pats ['if' ExprX] '=>' ;
Suffix = '.' ( ID ['::' GenericArgs] | NUM | 'await' ) | '(' [ Expr {',' Expr} [','] ] ')' | '[' Expr ']' | '?' ;
ClosureParam = {Attr} Pat [':' Type] ;
PathExpr = ['::'] SegName {'::' (SegName | GenericArgs)} | QPathExpr ;
QPathExpr = '<' Type ['as' Path] '>' {'::' (SegName | GenericArgs)} ;
StructLit = '{' [ FieldInit {',' FieldInit} [','] ] ['..' Expr] '}' ;
FieldInit = {Attr} (ID | NUM) [':' Expr] ;
MacroArgs = '!' ( '(' {Tree} ')' | '[' {Tree} ']' | '{' {Tree} '}' ) ;
Atom = NUM | STR | 'true' | 'false' | '_' | '(' [ Expr {',' Expr} [','] ] ')' | '[' [ Expr ( ';' Expr | {',' Expr} [','] ) ] ']' ;
Primary = Atom | PathExpr [StructLit | MacroArgs] | BlockLike ;
PrimaryX = Atom | PathExpr [MacroArgs] | BlockLikeX ;
BlockLikeX = 'unsafe' Block | If | Match | 'loop' Block ;
Pats = ['|'] Pat {'|' Pat} ;
Pat = ['ref'] ['mut'] PatPath [ '(' [ Pats {',' Pats} [','] ] ')' | '{' [ PatField {',' PatField} [','] ] '}' | '@' Pat | MacroArgs | PatRange ] | ['-'] NUM [PatRange] | STR [PatRange] | 'true' | 'false' | PatRange
  | ('&' | '&&') [LIFE] Pat | '(' [ Pats {',' Pats} [','] ] ')' | '[' [ Pats {',' Pats} [','] ] ']' | '_' ;
PatPath = ['::'] SegName {'::' (SegName | GenericArgs)} | QPathExpr ;
PatRange = ('..' | '..=' | '...') [ ['-'] NUM | STR | PatPath ] ;
PatField = {Attr} ( ['ref'] ['mut'] (ID | NUM) [':' Pats] | '..' ) ;
"""
    + _RUST_EXPR.replace("~", "").replace("$", "")
    + _RUST_EXPR.replace("~", "X").replace("$", "| 'let' Pats '='")
)

JAVA = """
Unit = [ {Annotation} 'package' Qual ';' ] { 'import' ['static'] Qual ['.' BIN] ';' | ';' } { TypeDecl | ';' } ;
Qual = ID {'.' ID} ;
Mods = { Annotation | MOD | 'non' '-' 'sealed' } ;
Annotation = '@' Qual [ '(' [ AnnItem {',' AnnItem} [','] ] ')' ] ;
AnnItem = AnnValue ['=' AnnValue] ;
AnnValue = Cond | Annotation | '{' [ AnnValue {',' AnnValue} [','] ] '}' ;
TypeDecl = Mods TypeKind ;
TypeKind = Class | Interface | Enum | Record | AnnType ;
@Class = 'class' ID [TypeParams] ['extends' Type] ['implements' Types] [Permits] ClassBody ;
@Interface = 'interface' ID [TypeParams] ['extends' Types] [Permits] ClassBody ;
Permits = 'permits' Types ;
@Enum = 'enum' ID ['implements' Types] '{' [ EnumConst {',' EnumConst} [','] ] [ ';' {Member} ] '}' ;
EnumConst = {Annotation} ID [Args] [ClassBody] ;
@Record = 'record' ID [TypeParams] '(' [Params] ')' ['implements' Types] ClassBody ;
AnnType = '@' 'interface' ID ClassBody ;
ClassBody = '{' {Member} '}' ;
Member = ';' | Block | 'static' Block | Mods ( TypeKind | [TypeParams] ( 'void' ID Method | Type ( ID ( Method | Vars ';' ) | Ctor | Block ) ) ) ;
@Method = '(' [Params] ')' {'[' ']'} ['throws' Types] ['default' AnnValue] ( Block | ';' ) ;
@Ctor = '(' [Params] ')' ['throws' Types] Block ;
Params = Param {',' Param} ;
Param = {Annotation | 'final'} Type ['...'] (ID | 'this') {'[' ']'} ;
Vars = {'[' ']'} ['=' VarInit] {',' ID {'[' ']'} ['=' VarInit]} ;
VarInit = Expr | ArrayInit ;
ArrayInit = '{' [ VarInit {',' VarInit} [','] ] '}' ;
TypeParams = '<' TypeParam {',' TypeParam} '>' ;
TypeParam = {Annotation} ID ['extends' Type {'&' Type}] ;
Types = Type {',' Type} ;
Type = {Annotation} BaseType {'[' ']'} ;
BaseType = PRIM | ID [TypeArgs] {'.' ID [TypeArgs]} ;
TypeArgs = '<' [ TypeArg {',' TypeArg} ] '>' ;
TypeArg = Type | '?' [('extends' | 'super') Type] ;
Block = '{' {BlockStmt} '}' ;
BlockStmt = Local ';' | LocalType | Stmt ;
LocalType = {Annotation | 'final' | 'abstract' | 'static'} ( Class | Interface | Enum | Record ) ;
Local = {Annotation | 'final'} Type ID Vars ;
Stmt = Block | ';' | 'if' '(' Expr ')' Stmt ['else' Stmt] | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | 'for' '(' ForHead ')' Stmt | Switch | 'return' [Expr] ';' | 'break' [ID] ';' | 'continue' [ID] ';' | 'throw' Expr ';'
  | 'synchronized' '(' Expr ')' Block | 'assert' Expr [':' Expr] ';' | Try | StmtExpr ';' | ID ':' Stmt | 'yield' Expr ';' ;
StmtExpr = {'++' | '--'} Primary {Suffix} [ (ASG | '=') Expr ] ;
ForHead = [ Local | Expr {',' Expr} ] ';' [Expr] ';' [ Expr {',' Expr} ] | {Annotation | 'final'} Type ID ':' Expr ;
Switch = 'switch' '(' Expr ')' '{' { ( 'case' CaseItem {',' CaseItem} ['when' Cond] | 'default' ) ( ':' {BlockStmt} | '->' ( Block | Expr ';' | 'throw' Expr ';' ) ) } '}' ;
CaseItem = Cond | 'default' | Type (ID | RecordPat) ;
RecordPat = '(' [ Pattern {',' Pattern} ] ')' ;
Pattern = ['final'] Type (ID | RecordPat) ;
Try = 'try' [ '(' Resource {';' Resource} [';'] ')' ] Block { 'catch' '(' {Annotation | 'final'} Type {BIN Type} ID ')' Block } [ 'finally' Block ] ;
Resource = {'final'} Type ID '=' Expr | Qual ;
Expr = Cond [ (ASG | '=') Expr | '->' (Block | Expr) ] ;
Cond = Bin [ '?' Expr ':' Expr ] ;
Bin = Unary { ( BIN | '&' | '+' | '-' | '<' | '>=' | '>' ['>' ['>']] ) Unary | 'instanceof' ['final'] Type [ID | RecordPat] } ;
Unary = {'+' | '-' | '!' | '~' | '++' | '--'} ( Primary {Suffix} | Cast ) ;
Cast = '(' Type {'&' Type} ')' Unary ;
Primary = ID | NUM | STR | 'this' | 'super' | 'true' | 'false' | 'null' | Paren | New | PRIM {'[' ']'} | 'void' | Switch ;
Paren = '(' [ Expr {',' Expr} ] ')' | '(' Params ')' ;
Suffix = '.' ( ID | 'class' | 'this' | 'super' | New | TypeArgs (ID | 'super') ) | Args | '[' [Expr] ']' | '++' | '--' | '::' ( [TypeArgs] ID | 'new' ) | TypeArgs '::' (ID | 'new') ;
Args = '(' [ Expr {',' Expr} ] ')' ;
New = 'new' {Annotation} BaseType ( Args [ClassBody] | '[' [Expr] ']' {'[' [Expr] ']'} [ArrayInit] ) ;
"""

C = """
Unit = {External} ;
@External = ';' | Specs [ InitDecl {',' InitDecl} ] ( ';' | Body | OldParams {OldParams} Body ) ;
OldParams = Specs InitDecl {',' InitDecl} ';' ;
@Body = '{' {BlockItem} '}' ;
Compound = '{' {BlockItem} '}' ;
Specs = {QUAL} ( Core | ID {QUAL} [Core] | 'typedef' Specs ) ;
Core = ( TYPE | StructSpec | EnumSpec ) { TYPE | QUAL } ;
@StructSpec = ('struct' | 'union') ( ID ['{' {Member} '}'] | '{' {Member} '}' ) ;
Member = ';' | Specs [ MemberDecl {',' MemberDecl} ] ';' ;
MemberDecl = Declarator [':' Cond] | ':' Cond ;
@EnumSpec = 'enum' ( ID [EnumBody] | EnumBody ) ;
EnumBody = '{' [ EnumItem {',' EnumItem} [','] ] '}' ;
EnumItem = ID ['=' Cond] ;
InitDecl = Declarator ['=' Init] ;
Declarator = {'*' {QUAL}} Direct ;
Direct = ( ID | '(' Declarator ')' ) { '[' {QUAL} [Assign | '*'] ']' | '(' [ Params ] ')' } ;
Params = Param {',' Param} [',' '...'] ;
Param = Specs [ AbsDecl ] ;
AbsDecl = '*' {'*' | QUAL} [AbsDirect] | AbsDirect ;
AbsDirect = ( ID | '(' AbsDecl ')' | AbsTail ) { AbsTail } ;
AbsTail = '[' {QUAL} [Assign | '*'] ']' | '(' [Params] ')' ;
TypeName = Specs [AbsDecl] ;
Init = Assign | InitList ;
InitList = '{' [ InitItem {',' InitItem} [','] ] '}' ;
InitItem = [ Designator {Designator} '=' ] Init ;
Designator = '.' ID | '[' Cond ['...' Cond] ']' ;
BlockItem = Local | Stmt ;
Local = Specs [ InitDecl {',' InitDecl} ] ';' ;
Stmt = Compound | ';' | 'if' '(' Expr ')' Stmt ['else' Stmt] | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | 'for' '(' ( Local | [Expr] ';' ) [Expr] ';' [Expr] ')' Stmt | 'switch' '(' Expr ')' Stmt
  | 'return' [Expr] ';' | 'break' ';' | 'continue' ';' | 'goto' ID ';' | 'case' Cond ['...' Cond] ':' | 'default' ':' | Expr ( ';' | ':' ) ;
Expr = Assign {',' Assign} ;
Assign = Cond [ (ASG | '=') Assign ] ;
Cond = Bin [ '?' [Expr] ':' Cond ] ;
Bin = Unary { (BIN | '+' | '-' | '*' | '&') Unary } ;
Unary = {'+' | '-' | '!' | '~' | '*' | '&' | '++' | '--'} ( Primary {Suffix} | Cast | Sizeof ) ;
Sizeof = 'sizeof' ( Unary | '(' TypeName ')' ) ;
Cast = '(' TypeName ')' ( Unary | InitList {Suffix} ) ;
Primary = ID | NUM | STR { STR | ID } | '(' ( Expr | Compound ) ')' ;
Suffix = '.' ID | '->' ID | '(' [ Assign {',' Assign} ] ')' | '[' Expr ']' | '++' | '--' ;
"""

RUBY = """
Program = Stmts ;
Stmts = [Stmt] { Term [Stmt] } ;
Term = NL | ';' ;
Stmt = ( ExprStmt | 'alias' Fname Fname | 'undef' Fname {',' Fname} | ('BEGIN' | 'END') Brace ) { ('if' | 'unless' | 'while' | 'until' | 'rescue') ExprStmt } ;
Fname = ID | CONST | SYM | IVAR ;
ExprStmt = NotExpr { ('and' | 'or') NotExpr } ;
NotExpr = {'not'} Multi ;
Multi = Expr { ',' MlhsItem } [ ('=' | ASG) Multi ] | '*' Expr { ',' MlhsItem } ['=' Multi] ;
MlhsItem = ['*' | SPLAT] Expr ;
Expr = Arg [ 'rescue1' Arg ] ;
Arg = Tern [ ('=' | ASG) ArgRhs ] ;
ArgRhs = ['*' | SPLAT] Arg [ 'rescue' Arg ] ;
Tern = Range [ '?' Tern (':' | LABEL) Tern ] ;
Range = Bin [ ('..' | '...') [Bin] ] ;
Bin = Unary { (BIN | '+' | '-' | '*' | '**' | '&' | '|' | '<' ) Unary } ;
Unary = {'-' | '+' | '!' | '~' | UMINUS | '&' | 'defined?'} Postfix ;
Postfix = Primary { '.' Called | '&.' Called | '::' Called | IDX [Args] ']' } ;
Called = ( ID | '(' [Args] ')' ) [ARGS [Args] ')'] [Brace | DoBlock | Command] | CONST [ ARGS [Args] ')' [Brace | DoBlock] ] ;
Command = CmdArg {',' CmdItem} [DoBlock] ;
CmdArg = CmdFirst | LABEL [CmdItem] ;
CmdFirst = CmdTern [ '=>' Arg ] | SPLAT Tern | BLOCKARG Tern | '**' Tern ;
CmdTern = CmdPrimary { '.' Called | '&.' Called | '::' Called | IDX [Args] ']' } { (BIN | '+' | '-' | '*' | '**' | '&' | '|' | '<') Unary } [ ('..' | '...') [Bin] ] [ '?' Tern (':' | LABEL) Tern ] [ ('=' | ASG) Arg ] ;
CmdPrimary = Word | Plain | UMINUS Primary | '!' Unary ;
CmdItem = ['*' | SPLAT | '**' | '&' | BLOCKARG] Arg ['=>' Arg] | LABEL [Arg] ;
Args = ArgItem {',' ArgItem} [','] {NL} ;
ArgItem = {NL} ( ('*' | SPLAT | '**' | '&' | BLOCKARG) [Arg] | Arg ['=>' Arg | Command1] | LABEL [Arg] ) ;
Command1 = 'rescue2' ;
Word = ( ID | 'super' | 'yield' ) [ ARGS [Args] ')' ] [Brace | DoBlock | Command] ;
Primary = Word | Plain | ARGS Stmts ')' | '[' [Args] ']' | Hash ;
Plain = CONST [ ARGS [Args] ')' [Brace | DoBlock] | Command2 ] | NUM | STR {STR} | SYM | IVAR | 'nil' | 'true' | 'false' | 'self' | '__FILE__' | '__LINE__' | '(' Stmts ')' | '::' CONST | Lambda | Def | Class | Module | Begin | If | While | Case | For | Jump ;
Command2 = STR {STR} ;
Jump = ('return' | 'break' | 'next') [Command3] | 'redo' | 'retry' ;
Command3 = JumpItem {',' JumpItem} ;
JumpItem = ['*' | SPLAT] Arg ['=>' Arg] | LABEL Arg ;
Hash = '{' {NL} [ HashItem {',' {NL} HashItem} [','] {NL} ] '}' ;
HashItem = '**' Arg | LABEL [Arg] | Arg ( '=>' {NL} Arg | ':' Arg ) {NL} ;
Brace = '{' [BlockParams] Stmts '}' ;
DoBlock = 'do' [BlockParams] BodyStmt 'end' ;
BlockParams = '|' [ Params ] [';' ID {',' ID}] '|' | '||' ;
Lambda = '->' [ ('(' | ARGS) [Params] ')' | Params ] ( Brace | DoBlock ) ;
Params = Param {',' {NL} Param} [','] {NL} ;
Param = ID ['=' Tern1] | LABEL [Tern1] | ('*' | '**' | '&' | SPLAT | BLOCKARG) [ID | 'nil'] | '...' | '(' Params ')' ;
Tern1 = Unary { ('+' | '-' | '*' | BIN) Unary } ;
@Def = 'def' [ ('self' | ID | CONST) '.' ] DefName ( ('(' | ARGS) {NL} [Params] {NL} ')' ( '=' Stmt | BodyStmt 'end' ) | '=' Stmt | [Params] Term BodyStmt 'end' ) ;
DefName = ID ['='] | CONST | BIN | '+' | '-' | '*' | '**' | '&' | '|' | '<' | '!' | '~' | '[' ']' ['='] | IDX ']' ['='] | LABEL ;
@Class = 'class' ( BIN Expr Term | CPath ['<' Expr] Term ) BodyStmt 'end' ;
CPath = ['::'] CONST {'::' CONST} ;
@Module = 'module' CPath Term BodyStmt 'end' ;
BodyStmt = Stmts {Rescue} ['else' Stmts] ['ensure' Stmts] ;
Rescue = 'rescue' [ RescueItem {',' RescueItem} ] ['=>' Postfix] ('then' | Term) Stmts ;
RescueItem = ['*' | SPLAT] Tern ;
Begin = 'begin' BodyStmt 'end' ;
If = ('if' | 'unless') ExprStmt Then Stmts {'elsif' ExprStmt Then Stmts} ['else' Stmts] 'end' ;
Then = Term {NL} ['then'] | 'then' ;
While = ('while' | 'until') ExprStmt ('do' | Term) Stmts 'end' ;
For = 'for' Postfix {',' Postfix} 'in' ExprStmt ('do' | Term) Stmts 'end' ;
Case = 'case' [ExprStmt] {Term} ( When {When} | In {In} ) ['else' Stmts] 'end' ;
When = 'when' RescueItem {',' {NL} RescueItem} Then Stmts ;
In = 'in' PatItem {',' PatItem} [('if' | 'unless') ExprStmt] Then Stmts ;
PatItem = ['*' | SPLAT | '**'] Arg ['=>' ID] | LABEL [Arg] ;
"""


def _js(text: str, typescript: bool) -> str:
    """Keeps or drops the parts in angle brackets; a quoted bracket is not one."""
    import re

    parts = re.split(r"('[^']*')", text)
    for i in range(0, len(parts), 2):
        parts[i] = parts[i].replace("<", "\x01").replace(">", "\x02")
    text = "".join(parts)
    if typescript:
        return text.replace("\x01", " ").replace("\x02", " ")
    return re.sub("\x01[^\x01\x02]*\x02", " ", text)


#: What may follow a syntax error inside a declaration, where a file as such cannot go on.
_REST = {"go": "Rest = { [TopDecl] ';' } ;\n", "java": "Rest = {Member} ;\n", "javascript": "Rest = {Member} ;\n", "typescript": "Rest = {Member} ;\n"}


def build(language: str, rest: bool = False) -> Grammar | None:
    """The grammar of a file, or with rest that of what goes on after an error, if it is another."""
    from . import lexers as L

    if rest and language not in _REST:
        return None
    more = _REST[language] if rest else ""

    if language == "go":
        return Grammar(GO + more, "Rest" if rest else "File", None, None, "Operand OperandX")
    if language == "python":
        return Grammar(PYTHON, "File")
    if language in ("javascript", "typescript", "tsx"):
        ts, jsx = language != "javascript", language == "tsx"
        context = (L.JS_CONTEXT + " " + (L.TS_CONTEXT if ts else "")).split()
        words = (L.JS_WORDS + " " + (L.TS_WORDS if ts else "")).split()
        prefer = {("Stmt", "{"): "Block", ("Stmt", "function"): "Func", ("Stmt", L.ASYNC_FUNCTION): "Func", ("Stmt", "class"): "Class", ("Stmt", "@"): "Class", ("ArrowBody", "{"): "Block", ("FuncEnd", "{"): "Block", ("Export", "function"): "Func", ("Export", L.ASYNC_FUNCTION): "Func", ("Export", "class"): "Class"}
        plain = _js(_JS, ts) + (_TS if ts else "")
        return Grammar((plain.replace("Primary = ", "Primary = Jsx | ") + _JSX if jsx else plain) + more, "Rest" if rest else "Program", prefer, {"ASI": [AUTO_SEMI], "ASYNCF": [L.ASYNC_FUNCTION], "CONTEXT": context, "WORD": words}, "Bin If Do Expr TypeOp Postfix Union Inter Lhs!<")
    if language == "rust":
        every = [*L.RUST_WORDS.split(), *(o for o in L.RUST_OPS.split() if o not in ("(", ")", "[", "]", "{", "}") and o not in L.RUST_BINARY.split()), "BIN", "ID", "NUM", "STR", "LIFE"]
        like = "{ unsafe async loop while for if match LIFE".split()
        prefer = {("Body", k): "BlockLike" for k in like} | {("Arms", k): "BlockLike" for k in like} | {("Bin", "&"): "Unary"}
        return Grammar(RUST, "File", prefer, {"ANYTOKEN": sorted(set(every)), "UNIONWORD": ["union-word"]}, "Bin BinX Expr ExprX Jump JumpX Type Bounds Pats Seg")
    if language == "java":
        mods = "public protected private abstract static final native synchronized transient volatile strictfp default".split()
        return Grammar(JAVA + more, "Rest" if rest else "Unit", {("BlockStmt", "PRIM"): "Local", ("BlockStmt", "switch"): "Stmt", ("Stmt", "switch"): "Switch"}, {"ID": ["ID", *L.JAVA_CONTEXT.split()], "MOD": [*mods, "sealed"]}, "Bin Cond Expr Stmt Suffix BaseType Type")
    if language == "c":
        return Grammar(C, "Unit", None, None, "Stmt StructSpec EnumSpec Primary")
    if language == "ruby":
        return Grammar(RUBY, "Program", None, None, "Arg ArgRhs Bin Range Tern Postfix Called!do Word!do Plain!do Command!do CmdTern Multi Args ArgItem Params Jump Command3 Expr Hash HashItem Then Case")
    raise ValueError(f"no grammar for {language}")
