"""Parsers on valid and invalid texts, and against the parsers Python has."""

import argparse
import ast
import bisect
import dataclasses
import heapq
import json
import json.decoder
import random
import textwrap
import tomllib
import warnings

import pytest

from graphloom.llm import syntax as S

# fmt: off
VALID = {
    'go': [
        'package main\n\nimport (\n\t"fmt"\n\tx "a/b"\n)\n\ntype T[K comparable, V any] struct {\n\ta, b int `json:"a"`\n\t*E\n\tF func(int) (string, error)\n}\n\ntype I interface {\n\tM(a int) string\n\t~int | string\n}\n\nfunc (t *T[K, V]) Do(ctx context.Context, xs ...int) (n int, err error) {\n\tif err := f(); err != nil {\n\t\treturn 0, err\n\t} else if x := (T{1}); x.a > 2 {\n\t}\n\tfor i, v := range xs {\n\t\tm[v]++\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tswitch x := y.(type) {\n\tcase int, []string:\n\tcase nil:\n\tdefault:\n\t}\n\tselect {\n\tcase <-ch:\n\tcase ch <- 1:\n\tcase v, ok := <-ch:\n\t}\n\tgo func() { a() }()\n\tdefer f(a, b...)\n\tvar m = map[string][]int{"a": {1, 2}, "b": nil}\n\tp := &T{a: 1, b: 2,\n\t}\n\tc := []byte("x")\n\tx, y = y, x\n\tlbl:\n\tfor ; ; {\n\t\tcontinue lbl\n\t}\n\tz := a[1:2:3]\n\tq := make(chan int, 3)\n\tw := Map[int, string](v)\n\tif v, ok := m["a"]; ok && !b {\n\t}\n\treturn\n}\n\nvar (\n\ta = 1\n\tb int\n)\n\nconst (\n\tA = iota\n\tB\n)\n\nvar x = struct{ a int }{1}\n',
        'package a',
        'package a\nfunc f() { x := []int{1,2}; for _, y := range []int{1} { _ = y } ; if f(T{1}) { } ; switch { case a > 1: b() } }',
    ],
    'java': [
        'package a.b; import static c.d.*; @A(x=1) public final class C<T extends D & E> extends F<G<H>> implements I, J { private static final int[] x = {1,2}; int y[] = new int[3][]; C(int a, String... b) throws X { this(a); super.foo(); } @Override public <U> List<U> m(final Map<String, ? super U> z) { for (int i = 0, j = 1; i < 3; i++, j--) { x[i] += (int) y[0] << 2; } for (var e : z.entrySet()) continue; if (a instanceof String s && s.length() > 1) return null; try (var r = open(); q) { } catch (A | B e) { throw e; } finally { } Runnable f = () -> { }; Function<A,B> g = (a1, b1) -> a1 + b1; var h = C::new; var k = int[]::new; switch (a) { case 1, 2 -> foo(); default -> { } } int w = switch (b) { case "x": yield 1; default: yield 2; }; do { } while (true); label: while (x) break label; synchronized (this) { } assert a > b : "x"; String t = """\n hi "x" \n"""; char c = \'\\n\'; return (List<U>) z.<U>get(1).a[2]; } enum E2 implements I { A(1) { void f() {} }, B; int q; } interface K<T> { default void d() {} int V = 1; } record R(int a, @N String b) { R { } } @interface An { int v() default 1; } static { } { } }',
        'class A { void f() { a < b; int x = a < b ? c : d; boolean q = a < b && c > d; List<List<String>> l = new ArrayList<>(); if (x) y(); else z(); Outer.Inner i = o.new Inner(); long m = 0xFFL >>> 2 >> 1; x >>= 2; Object o2 = new Object() { int a; }; String s = (String) o; int n = (x) + y; foo((a) -> b, c); } } ;',
        'import a.b;\nclass X{}\n// end',
    ],
    'javascript': [
        'var a=function(x){return this.r?x:null};',
        'function f(a,b){return a+b*2}',
        'var a={x:2,y:[3,5],z:"q"};',
        '!function(g){g.k=!0}(b||{});',
        'a.prototype.b=function(x){return this.r?x:null};',
        'var e=function(a){for(var n=0;n<a.length;n++)a[n]=4};',
        'for(var n=0;n<a;n++)a[n]=4',
        'for(var n=0;n<a;n++){a[n]=4}',
        'if(a)b=1\nelse c=2',
        'let x = a\n  .b()\nreturn1()',
        'x = {a, b(){ }, get c(){return 1}, async *d(){}, [e]: 2, ...f}',
        'const f = async ({a, b=2}, ...c) => { await a }',
        'label: for (const [a,b] of c) continue label',
        'a = b ? c : d => e',
        'class A extends B { #x = 1; static y; get z() { return this.#x } static { } async *g() {} }',
        "import a, {b as c} from 'd'; export default class {}; export * as q from 'z'",
        'a = `x${b + `${c}`}y`',
        'do x(); while(y) z()',
        '({a:1}).b',
        'x => ({a:1})',
        'a ??= b?.c?.[d]?.(e)',
        'if (a) { } else if (b) { }',
        'switch(a){case 1: b(); break; default: c()}',
        'return1: {}',
        'a\n++b',
        'var a = /[/]x/g.test(b), c = d / e / f',
        'new Foo(a).b(c)',
        'new a.b.C',
        'for (;;) {}',
        'for await (const x of y) {}',
        'try {} catch {} finally {}',
        'export const a = 1, b = 2',
        'let y = x\n/foo/g.exec(z)',
    ],
    'json': [
        '{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}}',
        '[]',
        '"x"',
        ' 1 ',
    ],
    'python': [
        '',
        '# c',
        'x = 1',
        'async def f(*a: int, b=1, **k) -> None:\n    """d"""\n    async with x as y, z: pass\n    async for i in y: await i\n    return [*a, *(b async for b in c if d)]\n',
        'match x:\n    case {"a": [1, *r], **k} if y: pass\n    case A.B(c, d=2) | None: pass\n    case _: pass\n',
        'match = 1\nprint(match, type, case)\n',
        '@d.e(1)\nclass A(B, metaclass=C):\n    x: int = 1\n\n    y = lambda a, *b, c=1: a if b else c\n',
        'try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n',
        'x = {**a, "b": 1, **c}; y = {1, *z}; z = {k: v for k, v in a.items() if k if v}\n',
        'with (open(a) as b, open(c) as d):\n    pass\n',
        'x[1:2, ::3, ...] = y @ z ** -w\n',
        'def f(a, /, b, *, c): pass\n',
        'if (n := 10) > 5: print(f"{n!r:>{w}} {{}}")\n',
        'from . import (a as b, c,)\nfrom ...x import *\n',
        'x = not a in b is not c\ndel a, b[0]\nglobal q\n',
        'type X[T: int] = list[T]\ndef g[T](a: T) -> T: return a\n',
        'x = 1 if a else \\\n  2\n',
        'for x in *a, b:\n    pass\nelse:\n    pass\n',
    ],
    'rust': [
        '#![allow(x)]\nuse std::{fmt, io::{self, Read as R}, *};\n#[derive(Debug, Clone)]\npub(crate) struct A<\'a, T: Fn(i32) -> u8 + \'a = X, const N: usize = 3> where T: Send { pub a: &\'a mut T, b: Vec<Option<Box<dyn Tr<Item = u8>>>> }\nstruct U;\nstruct P(pub i32, u8);\nenum E { A, B(i32), C { x: u8 } , D = 4 }\nimpl<\'a, T> Tr for A<\'a, T> where T: Clone { type X = u8; const Y: i32 = -1; fn f(&mut self, (a, b): (i32, i32), _: u8) -> Result<(), Box<dyn Error>> { let x = if a > b { 1 } else { 2 }; let Some(y) = z else { return Ok(()) }; if let Some(q) = w && q > 1 { } while let Ok(v) = it.next() { } for i in 0..10 { continue; } match x { 1 | 2 => {} 3..=5 if y => foo(), A::C { x, .. } => { } ref r @ Some(_) => panic!("a {}", b), _ => return Err("x".into()), } let c = move |a: i32, b| a + b; let d = || -> i32 { 1 }; vec![1, 2, 3]; let s = S { a: 1, b, ..Default::default() }; let t = a as usize < b; x.iter().map(|x| x * 2).collect::<Vec<_>>()?; unsafe { *p = 1; } \'l: loop { break \'l; } let r = &mut a[1..]; a.0.1 = 2; match x {} .y; async move { b.await }; let h = r#"raw "x" "#; let ch = \'\\\'\'; let b = b"x"; let f = 1.5e3_f64; x <<= 2; y >>= 1; } }\nmacro_rules! m { ($a:expr, $($b:ty),*) => { $a; $(foo::<$b>();)* } }\nmod q { pub fn z() {} }\nextern "C" { fn x(a: i32) -> *const u8; }\nstatic mut X: [u8; 3] = [0; 3];\ntype F = fn(i32, &str) -> Option<u8>;\ntrait Tr: Sized + \'static { fn g(self: Box<Self>) -> impl Iterator<Item = u8> + \'_; }\npub const fn k<T>() where T: ?Sized {}\n',
        'fn main() { println!("{}", x); }\n// end',
        'fn f() -> Option<&str> { let x = y; match z { Some(x) => a(x), None => {} } ; for row in f(x) { g(row, 1); } if a.is_empty() { return None; } log::info!("x ( {}", a); a }',
    ],
    'toml': [
        '',
        '# c\n[a.b]\nc = 1 # x\nd = "x"\n[[e]]\nf = [1,\n 2,\n]\ng = {h = 1, "i j" = 1979-05-27T07:32:00Z}\nk.l = \'\'\'\nx\'\'\'\n',
        'a = +1_000\nb = inf\nc = 0xff\nd = 1e6\ne = 07:32:00\n',
    ],
    'typescript': [
        '@Component({a: 1}) export class A { @Input() b: string; constructor(@Inject(X) private readonly y: Y<Z>) {} get v(): number { return 1 } m<T>(this: A, ...r: T[]): r is T { return r } }',
        'const a = <T,>(x: T) => x; let f: typeof a; type R = Record<string, { a: number; b?: string }>;\nlet o = { a, b() {}, async c() {}, get d() { return 1 } } as const;',
        'export async function* g<T extends keyof U = "x">(a = 1): AsyncIterable<T> { for await (const x of y) yield* z }',
        'const a: Map<string, number[]> = new Map<string, number[]>();',
        'function f<T extends {a: number}>(x: T, y?: string, ...z: any[]): x is string { return x as any }',
        'interface A<T> extends B<T>, C { a: string; readonly b?: number, c(x: number): void\n d: () => void; [k: string]: any }',
        'type A = B extends infer C ? D<C> : never',
        'type M = { readonly [K in keyof T]?: T[K] }',
        "enum E { A = 1, B, 'c' }",
        "abstract class X<T> implements Y { private readonly a: string = 'x'; constructor(private b: number, public c?: string) { super() } abstract foo(): void; @dec() bar!: string; static async *x<T>(): AsyncGenerator<T> {} }",
        "declare module 'x' { export function f(): void }",
        'let x = <any>y; let z = a!.b!',
        'type F = (a: string, b?: number) => Promise<void> | null',
        "export type { A } from './b'; import type { C } from 'd'",
        'function f(this: Window, a: number): asserts a is string;',
        'const x = a < b && c > d',
        'const f = async <T,>(x: T): Promise<T> => x',
        'namespace A.B { export const c = 1 }',
        'let u: unique symbol; let t: [a: string, b?: number, ...c: any[]]',
        'let v = a satisfies B',
        'const y = x as const;',
        'let q = a ? (b) : c => d',
        "type X = typeof import('a')",
        'export default interface A { }',
        "let g = f<string>('a')",
        'type T = `a${string}`',
        'const s1: Map<string, Map<string, number>> = x',
    ],
    'xml': [
        '<?xml version="1.0"?>\n<!-- c -->\n<!DOCTYPE a>\n<a x="1" y=\'2\'>t &amp; &#10; <b/><![CDATA[ <x> ]]><?p q?></a>\n',
        '<a/>',
    ],
    'yaml': [
        'a: 1\nb:\n  - c\n  - d: e\n    f: g\n  -\n    h: i\n  - - x\n    - y\nj: |\n  text: here\n    more\nk: >-\n  folded\nl: {a: 1, b: [x, y], "c": d}\nm: "multi\n  line"\nn: plain\n  continued text\no: &anchor\n  p: *alias\nq: !!str 5\n? complex\n: value\nurl: http://x.y/z\nt: \'it\'\'s\'\n"quoted key": x\n# end\n',
        '- a\n- b\n',
        '---\na: b\n...\n---\nc: d\n',
        'just text\nmore text',
        '',
        '# only comment\n',
        'a:\n- b\n- c\nd: e\n',
        'a: [1,\n  2,\n  3]\nb: c',
        'key: x',
        '<<: *default\nx: y\n',
        'a: b # comment\nc: "d" # x\ne:   # only comment\n  f: g\n',
        '- name: x\n  run: |\n    a: b\n  with:\n    k: v\n- name: y\n',
    ],
}
INVALID = {
    'go': [
        'package a\nfunc f() {\n\tx := \n}\n',
        'package a\nfunc f()\n{\n}\n',
        'func f() {}\n',
        'package a\nfunc f() { x := 1 y := 2 }',
        'package a\nfunc f() { if x { }',
    ],
    'java': [
        'class A { void f() { int x = ; } }',
        'class A { void f( { } }',
        'class A { ',
        'class A { int x = 1 }',
        'foo bar',
        'class A { void f() { if (x { } } }',
    ],
    'javascript': [
        'let x: number = 1',
        'function f() {',
        'foo(',
        'import a from',
        'const x = {a: 1',
        'class A { private x }',
        'let x = 5 5',
        '}',
        'if (a) else',
        'x = `abc',
        'interface A {}',
        '{ "a": 1 }',
        '<!DOCTYPE html>\n<p>x</p>',
        'x = 1\n<<<<<<< HEAD\ny = 2\n=======\ny = 3\n>>>>>>> b\n',
    ],
    'json': [
        "{'a': 1}",
        '{"a": 1,}',
        '[1 2]',
        '',
        '{"a"}',
        '01',
        '"\t"',
        '[1] []',
        'NaN',
    ],
    'python': [
        'def f(:\n  pass\n',
        'x = (1,\n',
        'if x\n  y\n',
        'def f():\nx = 1\n',
        '  x = 1\n',
        'x = 1\n <<<<<<< HEAD\n',
        'class A:\n    def f(self):\n        return 1\n      y = 2\n',
        'print("a\n',
        '<html></html>\n',
        'x = [1, 2)\n',
    ],
    'rust': [
        'fn f( { }',
        'fn f() { let x = ; }',
        'struct A { a: i32 b: u8 }',
        'fn f() { foo(1, 2 }',
        'let x = 1;',
        'fn f() { a b }',
    ],
    'toml': [
        'a = ',
        'a b = 1',
        '[a',
        'a = 1 b = 2',
        'a = [1, 2',
        '= 1',
    ],
    'typescript': [
        'const x: = 1',
        'function f(a: number { }',
        'class A { foo( }',
        'let a = 1 let b',
        'interface A { a: }',
    ],
    'xml': [
        '<a><b></a>',
        '<a',
        '<a>&</a>',
        'text',
        '<a/><b/>',
        '<a x="1" x="2"/>',
        '<?xml version="1.0"?>',
    ],
    'yaml': [
        'a: b: c\n',
        'a: [1, 2\n',
        'a: "x\n',
        'a:\n  b: 1\n c: 2\n',
        '- a\nb: c\n',
        'a: {b: c\n',
        '\ta: b\n',
        'a: b\n- c\n',
        'a: *\n',
        'x: @foo\n',
        'a: b\nfoo\nc: d\n',
    ],
}
# fmt: on


@pytest.mark.parametrize(("language", "text"), [(lang, t) for lang, ts in VALID.items() for t in ts])
def test_valid(language, text):
    assert S.first_error(text, language) is None
    assert S.first_error("\ufeff" + text, language) is None


@pytest.mark.parametrize(("language", "text"), [(lang, t) for lang, ts in INVALID.items() for t in ts])
def test_invalid(language, text):
    assert S.first_error(text, language) is not None


def parses(language, text):
    try:
        if language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif language == "json":
            json.loads(text)
        else:
            tomllib.loads(text)
    except (SyntaxError, ValueError):
        return False
    return True


@pytest.mark.parametrize("language", ["python", "json", "toml"])
def test_damaged_texts_agree_with_the_standard_parser(language):
    """Random deletions, without the confirming parser: nearly always the same verdict, never a crash."""
    rng = random.Random(7)
    agree = total = 0
    for text in VALID[language]:
        for _ in range(12 if text else 0):
            i = rng.randrange(len(text))
            hurt = text[:i] + text[i + rng.randrange(1, 4):]
            total += 1
            agree += (S.first_error(hurt, language) is None) == parses(language, hurt)
    assert agree >= 0.93 * total


def test_error_places():
    assert S.first_error("x = 1\n\n<<<<<<< HEAD\ny = 2\n", "python")[0] == 3
    assert S.first_error("class A {\n  void f() {\n", "java") == (3, "end of file")
    assert S.first_error("let a = 1;\nlet b = = 2;\n", "javascript") == (2, "unexpected =")


def test_deep_nesting_and_long_texts():
    assert S.first_error("[" * 20000 + "]" * 20000, "json") is None
    assert S.first_error("[" * 20000 + "]" * 19999, "json") is not None
    assert S.first_error("x = 1;\n" * 20000, "javascript") is None


SCHEMA = "repo_id string, file_id string, blob_sha string, language string, text string, valid string, kinds int"


def test_table(spark):
    rows = [
        ("r", "a", "1", "python", "x = 1\n", "v", 1), ("r", "a", "1", "python", "x = 1\n", "v", 1), ("r", "a", "2", "python", "x = (\n", None, 1), ("r", "b", "1", "json", "", None, None),
        ("r", "c", "1", None, "x", None, None), ("r", "d", "1", "cobol", "x", None, None), ("r", "e", "1", "go", None, None, None), (None, None, None, "python", "x ==", None, None),
    ]
    out = S.parsed(spark.createDataFrame(rows, SCHEMA))
    got = {(r.file_id, r.blob_sha): r.valid for r in out.collect()}
    assert got == {("a", "1"): True, ("a", "2"): False, ("b", "1"): False, ("c", "1"): None, ("d", "1"): None, ("e", "1"): None, (None, None): False}
    rate = {(r.repo_id, r.language): (r.files, r.invalid, r.rate) for r in S.rates(out).collect()}
    assert rate[("r", "python")] == (2, 1, 0.5)
    assert S.parsed(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    ("language", "text"),
    [
        ("python", "x = f'{a b}'\n"), ("python", "x = f'{1 +}'\n"), ("python", "x = 1\ny = rf\"\"\"{a:>{b c}}\"\"\"\n"), ("python", "x = f'{}'\n"), ("python", "x = f'{a!z}'\n"), ("python", "x = f'{a) + (b}'\n"),
        ("javascript", "x = `${x y}`"), ("javascript", "x = `a${a +}b`"), ("javascript", "x = `${}`"), ("javascript", "x = `${a) + (b}`"), ("javascript", "x = `${f(() => { let = 1 1; })}`"),
        ("typescript", "const x: string = `${a +}`"), ("typescript", "x = `${`${b c}`}`"),
    ],
)
def test_errors_inside_interpolations(language, text):
    assert S.first_error(text, language) is not None


@pytest.mark.parametrize(
    ("language", "text"),
    [
        ("python", "x = f'{a!r:>{w}} {{}} {b=} {c[\"k\"]:%Y-%m-%d} {d != e} {(lambda: 1)()} {*f,}'\n"), ("python", "x = f'\\N{DASH} {a}' rf'\\{b}' f'{ {1: 2}[1] } {c = !r}'\n"),
        ("javascript", "x = `${a, b} ${() => { return {c: 1}; }} \\${ ${await d}`"), ("typescript", "type T = `a${string}-${keyof U & string}-${infer V}`"), ("typescript", "x = `${a as string}${b!}`"),
    ],
)
def test_valid_interpolations(language, text):
    assert S.first_error(text, language) is None


@pytest.mark.parametrize(
    ("language", "text", "valid"),
    [
        ("java", "class A { int f(Object o) { return switch (o) { case P(var a, _) -> 2; default -> 1; }; } }", True),
        ("typescript", "type X<T> = T extends infer U extends string ? U : never;", True), ("typescript", "return 1;", False),
        ("javascript", "if (a) { return 1; }\n", False), ("javascript", "function f() { if (a) { return 1; } }\nclass A { m() { switch (a) { case 1: return 2; } } }\n", True),
        ("javascript", "const f = async () => { try { return 1; } catch { return 2; } };\nx: while (1) { break x; }\n", True),
        ("python", "print(f\"{x!r:>{w}} {f'{y}'}\")\n", True), ("python", 'x = f"{a["b"]}"\n', True), ("python", 'x = f"a } b"\n', False), ("python", "f(a=1, 2)\n", False),
        ("python", "f(a, *b, c, d=1, *e, **k, g=2,)\n", True), ("python", "f(**k, *a)\n", False), ("python", "f(x for x in y)\n", True), ("python", "f(x for x in y, 1)\n", False),
        ("python", "def f(a, b=1, /, c=2, *, d, e=3, **k): pass\n", True), ("python", "def f(a=1, b): pass\n", False), ("python", "def f(*, **k): pass\n", False), ("python", "lambda *: 0\n", False),
        ("python", "a + 1 = 2\n", False), ("python", "f() = 1\n", False), ("python", "(a, [b, *c]), d = e.f[1:2] = g\n", True), ("python", "a, b += 1\n", False), ("python", "del f()\n", False),
        ("python", "for f() in d: pass\n", False), ("python", "with (a as b, c as (d, e),): pass\n", True), ("python", "x = a + not b\n", False), ("python", "x = not a and not b or c\n", True),
        ("python", 'x = "a" b"b"\n', False), ("python", 'x = "\\x4"\n', False), ("python", 'x = "\\x41" r"\\x4"\n', True), ("python", "x = 012\n", False), ("python", "x = 0, 00, 012.5\n", True), ("python", "[*x for x in y]\n", False),
    ],
)
def test_fine_points_of_the_grammars(language, text, valid):
    assert (S.first_error(text, language) is None) is valid


def test_python_grammar_against_the_standard_parser():
    """Real modules, whole and damaged: the same verdict in all but a few of a thousand."""
    rng = random.Random(3)
    agree = total = 0
    for module in (argparse, bisect, dataclasses, heapq, json.decoder, textwrap, random):
        text = open(module.__file__, encoding="utf-8").read()
        assert S.first_error(text, "python") is None
        lines = text.split("\n")
        for _ in range(25):
            k = rng.randrange(max(1, len(lines) - 120))
            part = "\n".join(lines[k:k + 120])
            i = rng.randrange(len(part))
            for hurt in (part[:i] + part[i + rng.randrange(1, 4):], part[:i] + rng.choice("()[]{}:,=.*\"'\\@;+-") + part[i:]):
                total += 1
                agree += (S.first_error(hurt, "python") is None) == parses("python", hurt)
    assert agree >= 0.99 * total
