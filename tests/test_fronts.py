"""Facts of each language's front-end over small texts."""

import pytest

from loomgraph.plans.build import front_ends

ENDS = front_ends()


def parse(lang, source):
    f = ENDS[lang](source)
    return f, {(s["name"], s["kind"], s["owner_type"]) for s in f["symbols"]}, {(r["name"], r["role"], r["receiver"], r["arg_count"]) for r in f["refs"]}


def locals_of(f):
    return {d["name"] for d in f["scope_defs"] if d["symbol"] is None}


def test_every_language_has_a_front_end_that_takes_anything():
    assert len(ENDS) == 14
    for end in ENDS.values():
        for text in ("", "\n", "}", "((", "class", "a.b(", "fn f(", "`${", "/* x", '"', "class A { void m( }", "€ \U0001f600"):
            f = end(text)
            assert f is None or set(f) == {"symbols", "refs", "imports", "scopes", "scope_defs"}


SCRIPT = """import Def, { a as b, c } from './m';
import * as ns from "./ns"; import './side';
export { x as y } from './re'; export * from './star';
export default class Derived<T> extends NS.Base<T> implements Greeter, Other<string> {
  handler = async (e: Event) => { this.run(e); };
  constructor(private x: number, ...rest: string[]) { super(x); helper(`a ${inner(1, 2)} b`); }
  private static async *run<T>(a: Map<string, number>, b = f(3)): Promise<void> { for (const k of list) { a.b.c(k); new Foo.Bar(1); } }
  abstract speak(): void;
  get value() { return /re"g/.test(x) ? 1 : 2; }
}
interface IC extends IA, IB { greet(name: string): string; prop: number; }
class Mixed extends wrap(Box) {}
export const arrow = (a, { b, c }, [d]) => { const z = a.map(q => q.w(1)); return z; };
namespace Out.In { export class Deep {} }
"""


@pytest.mark.parametrize("lang", ["typescript", "tsx", "javascript"])
def test_ecmascript(lang):
    f, symbols, refs = parse(lang, SCRIPT)
    assert symbols == {
        ("Derived", "class", None), ("constructor", "method", "Derived"), ("run", "method", "Derived"), ("speak", "method", "Derived"), ("value", "method", "Derived"), ("IC", "interface", None),
        ("greet", "method", "IC"), ("Mixed", "class", None), ("arrow", "function", None), ("In", "module", None), ("Deep", "class", None),
    }
    by = {s["name"]: s for s in f["symbols"]}
    assert by["Derived"]["export_name"] == "default" and by["arrow"]["exported"] and not by["IC"]["exported"] and by["Deep"]["exported"]
    assert (by["run"]["visibility"], by["run"]["is_static"], by["run"]["param_count"], by["run"]["variadic"]) == ("private", True, 2, False)
    assert by["speak"]["is_abstract"] and by["constructor"]["variadic"] and by["value"]["visibility"] is None
    assert {("Base", "extends", "NS", None), ("Greeter", "implements", None, None), ("Other", "implements", None, None), ("IA", "extends", None, None), ("IB", "extends", None, None)} <= refs
    assert {("run", "call", "this", 1), ("inner", "call", None, 2), ("c", "call", "a.b", 1), ("Bar", "call", "Foo", 1), ("f", "call", None, 1), ("wrap", "call", None, 1), ("w", "call", "q", 1)} <= refs
    assert not any(r[0] in ("Box", "super") for r in refs) and ("wrap", "extends", None, None) not in refs
    assert [(i["kind"], i["source"], i["imported_name"], i["local_name"]) for i in f["imports"]] == [
        ("default", "./m", "default", "Def"), ("named", "./m", "a", "b"), ("named", "./m", "c", "c"), ("namespace", "./ns", None, "ns"), ("side-effect", "./side", None, None),
        ("reexport", "./re", "x", "y"), ("reexport-star", "./star", None, None),
    ]
    assert {"rest", "x", "a", "b", "k", "e", "c", "d", "z", "q"} <= locals_of(f)


def test_columns_are_utf16_and_names_have_their_place():
    f, _, _ = parse("typescript", "/* \U0001f600 */ function tail() { go(); }\n")
    assert f["symbols"][0]["name_range"] == (1, 18, 1, 22) and f["symbols"][0]["range"] == (1, 9, 1, 34)


def test_go():
    f, symbols, refs = parse(
        "go",
        'package main\nimport (\n "fmt"\n m "a/b/pkg"\n _ "side"\n . "dot/x"\n)\ntype Shape interface { Area() float64 }\ntype Circle struct { R float64 }\nfunc (c *Circle) Area() float64 { return m.Pi(c.R, 2) }\n'
        'func Map[T any](xs []T, f func(T) T) []T {\n for i, x := range xs { xs[i] = f(x) }\n go fmt.Println("x")\n return xs\n}\nfunc helper(a, b int, rest ...string) {}\nvar top = helper(1, 2)\n',
    )
    assert symbols == {("Shape", "interface", None), ("Circle", "type", None), ("Area", "method", "Circle"), ("Map", "function", None), ("helper", "function", None)}
    assert refs == {("Pi", "call", "m", 2), ("f", "call", None, 1), ("Println", "call", "fmt", 1), ("helper", "call", None, 2)}
    assert [(i["kind"], i["source"], i["local_name"]) for i in f["imports"]] == [("namespace", "fmt", "fmt"), ("namespace", "a/b/pkg", "m"), ("side-effect", "side", None), ("wildcard", "dot/x", None)]
    by = {s["name"]: s for s in f["symbols"]}
    assert by["Area"]["exported"] and not by["helper"]["exported"] and (by["helper"]["param_count"], by["helper"]["variadic"]) == (2, True)
    assert {"i", "x", "c", "xs", "a", "b", "rest"} <= locals_of(f) and "visibility" not in by["Area"]


def test_java():
    f, symbols, refs = parse(
        "java",
        "package a.b;\nimport x.y.Z; import static p.Q.m; import static p.Q.*; import r.s.*;\n@Deprecated(since = \"1\")\npublic abstract class Cat<T extends Foo> extends Base2 implements Pet, Comparable<Cat> {\n"
        " private static final Map<String, List<Integer>> names = new HashMap<>();\n public Cat(int a) { super(a); helper(a); }\n @Override public String name(String a, int... b) throws IOException { int local = 3; for (Foo f : foos) { f.bar(local); } return Z.make(a, b); }\n"
        " protected abstract void speak();\n static <R> R gen(R r) { return list.stream().map(q -> q.go()); }\n enum Kind { A(1), B; Kind() {} int code() { return 1; } }\n interface Inner extends I1, I2 { void f(); }\n}\nrecord Point(int x, int y) implements Shape { }\n",
    )
    assert symbols == {
        ("Cat", "class", None), ("name", "method", "Cat"), ("speak", "method", "Cat"), ("gen", "method", "Cat"), ("Kind", "enum", "Cat"), ("code", "method", "Kind"), ("Inner", "interface", "Cat"),
        ("f", "method", "Inner"), ("Point", "record", None),
    }
    by = {s["name"]: s for s in f["symbols"]}
    assert (by["name"]["visibility"], by["name"]["variadic"], by["speak"]["is_abstract"], by["gen"]["is_static"], by["gen"]["visibility"]) == ("public", True, True, True, None)
    assert {("Base2", "extends", None, None), ("Pet", "implements", None, None), ("Comparable", "implements", None, None), ("I2", "extends", None, None), ("Shape", "implements", None, None)} <= refs
    assert {("HashMap", "call", None, 0), ("bar", "call", "f", 1), ("make", "call", "Z", 2), ("map", "call", "list.stream()", 1), ("go", "call", "q", 0)} <= refs
    assert [(i["kind"], i["source"], i["local_name"], i.get("is_static")) for i in f["imports"]] == [("named", "x.y", "Z", None), ("named", "p.Q", "m", True), ("wildcard", "p.Q", None, True), ("wildcard", "r.s", None, None)]
    assert {"names", "a", "b", "local", "f", "q"} <= locals_of(f)


def test_csharp():
    f, symbols, refs = parse(
        "csharp",
        "namespace Geo;\npublic interface IShape { double Area(); }\npublic class Circle : Ns.Base<int>, IShape {\n public double Radius { get; set; }\n public double Area() { var scale = 3.14; return scale; }\n}\n"
        "public class Program {\n public static void Main() {\n  var c = new Circle();\n  c.F(1, 2); Helper(1, 2, 3);\n  foreach (var x in xs) {} try {} catch (System.Exception ex) {}\n }\n static void Helper() {}\n}\n",
    )
    assert {("IShape", "interface", None), ("Radius", "property", "Circle"), ("Area", "method", "Circle"), ("Area", "method", "IShape"), ("Main", "method", "Program"), ("Helper", "method", "Program")} <= symbols
    assert {("Base", "extends", "Ns", None), ("IShape", "extends", None, None), ("F", "call", "c", 2), ("Helper", "call", None, 3), ("Circle", "call", None, 0)} <= refs
    assert {"x", "ex", "scale", "c"} <= locals_of(f)


def test_c_and_cpp():
    f, symbols, refs = parse("c", "#define X(a) a('\nstruct point { int x; };\nstatic int add(int a, int b) { int sum = a + b; return sum; }\nint main(void) { struct point p; p.x = add(1, 2); return ptr->fn(3); }\n")
    assert symbols == {("point", "class", None), ("add", "function", None), ("main", "function", None)} and {"a", "b", "sum", "p"} <= locals_of(f)
    assert refs == {("add", "call", None, 2), ("fn", "call", "ptr", 1)}
    f, symbols, refs = parse(
        "cpp",
        "namespace geo {\nclass Shape { public: virtual double area() const = 0; Shape(int a) : a_(a) {} ~Shape(); private: int a_; };\nstruct Circle : public Shape, private ns::Other<int> { double area() const override { return helper(r); } };\n}\n"
        "double geo::Circle::perimeter(double k) { auto c = new Circle(1); c->area(); C::stat(2); return k; }\nint free_fn(int a, char *b);\ntemplate <typename T> T tmax(T a, T b) { return a; }\n",
    )
    assert symbols == {
        ("geo", "module", None), ("Shape", "class", None), ("area", "method", "Shape"), ("Shape", "function", "Shape"), ("Circle", "class", None), ("area", "method", "Circle"), ("perimeter", "method", "Circle"),
        ("free_fn", "function", None), ("tmax", "function", None),
    }
    assert refs == {("Shape", "extends", None, None), ("Other", "extends", "ns", None), ("helper", "call", None, 1), ("Circle", "call", None, 1), ("area", "call", "c", 0), ("stat", "call", "C", 1)}


def test_rust():
    f, symbols, refs = parse(
        "rust",
        "pub struct Point { x: i32 }\npub trait Shape { fn area(&self) -> f64; fn name(&self) -> String { String::from(\"x\") } }\nimpl<T> Shape for Wrapper<T> where T: Foo { fn area(&self) -> f64 { let (a, b) = (1, 2); helper::<i32>(a) } }\n"
        "impl Point { pub fn new(x: i32) -> Self { println!(\"hi {}\", x); let f = |q, w: i32| q.go(w); for i in 0..3 { go(i); } Point { x } } }\nmod inner { pub fn deep<'a>(s: &'a str) -> &'a str { s } }\n",
    )
    assert symbols == {("Point", "class", None), ("Shape", "interface", None), ("name", "method", "Shape"), ("area", "method", "Wrapper"), ("new", "method", "Point"), ("inner", "module", None), ("deep", "function", None)}
    assert refs == {("from", "call", "String", 1), ("helper", "call", None, 1), ("println", "call", None, 2), ("go", "call", "q", 1), ("go", "call", None, 1)}
    assert {"a", "b", "f", "q", "w", "i", "s", "x"} <= locals_of(f)


def test_kotlin():
    f, symbols, refs = parse(
        "kotlin",
        "package com.example\ninterface Greeter { fun greet(name: String): String }\nobject Util { fun shout(s: String): String = s.uppercase() }\nclass Derived(x: Int, val count: Int) : Base(), Iface {\n    override fun i() {}\n"
        "    fun run(h: Holder) {\n        val msg = 1\n        this.helper()\n        h.inner.helper()\n        list.map { a -> a.foo(2) }\n    }\n    fun helper() {}\n}\n",
    )
    assert symbols == {
        ("Greeter", "interface", None), ("greet", "function", "Greeter"), ("Util", "object", None), ("shout", "function", "Util"), ("Derived", "class", None), ("count", "property", "Derived"), ("i", "function", "Derived"),
        ("run", "function", "Derived"), ("helper", "function", "Derived"),
    }
    assert {("Base", "extends", None, None), ("Iface", "extends", None, None), ("helper", "call", "this", 0), ("helper", "call", "h.inner", 0), ("foo", "call", "a", 1)} <= refs and {"x", "msg", "a", "h"} <= locals_of(f)


def test_scala():
    f, symbols, refs = parse(
        "scala",
        "trait Shape { def area: Double; def name(): String = \"x\" }\ncase class Circle(r: Double) extends Base[Int](r) with Shape {\n  override def area: Double = math.Pi * pow(r, 2)\n  def run[T](a: T)(implicit b: Int): Unit = {\n    val q = list.map(z => z.w(1))\n    for (i <- 0 to 3) { go(i) }\n  }\n}\n"
        "object Main extends App { def main(args: Array[String]): Unit = println(\"x\") }\n",
    )
    assert {("Shape", "interface", None), ("Circle", "class", None), ("area", "function", "Circle"), ("run", "function", "Circle"), ("Main", "object", None), ("main", "function", "Main")} <= symbols
    assert {("Base", "extends", None, None), ("Shape", "extends", None, None), ("App", "extends", None, None), ("pow", "call", None, 2), ("w", "call", "z", 1), ("go", "call", None, 1)} <= refs
    assert {"q", "z", "i", "a", "b", "r"} <= locals_of(f)


def test_php():
    f, symbols, refs = parse(
        "php",
        "<html> it's <?php\nnamespace App;\n#[Attr(1)]\nabstract class User extends Base\\Model implements \\JsonSerializable, Foo {\n  public function name(string $a, ...$rest) { $x = strlen($a); foreach ($rest as $k => $v) { $this->go($v); self::stat(1); } return new Foo\\Baz($x); }\n"
        "  protected static function stat(int $n = 3) {}\n}\nfunction helper($a) { $f = fn($y) => run($y); return array_map(function($q) use ($a) { return $q; }, []); }\n?> don't f(x)\n",
    )
    assert symbols == {("User", "class", None), ("name", "method", "User"), ("stat", "method", "User"), ("helper", "function", None)}
    assert {("Model", "extends", "Base", None), ("JsonSerializable", "implements", None, None), ("Foo", "implements", None, None), ("go", "call", "$this", 1), ("stat", "call", "self", 1), ("Baz", "call", "Foo", 1), ("run", "call", None, 1)} <= refs
    assert {"$a", "$rest", "$x", "$k", "$v", "$q", "$y"} <= locals_of(f) and f["symbols"][0]["name_range"][0] == 4


def test_ruby():
    f, symbols, refs = parse(
        "ruby",
        "require 'x'\nmodule Zoo\n  class Car < Base::Vehicle\n    def initialize(a, b = 2, *rest)\n      super(a)\n      @x = helper(a, b)\n      total = 0\n      rest.each do |r, s|\n        total += r.weigh(1) if r.ok?\n      end\n"
        "      while total > 3 do\n        total -= 1\n      end\n    end\n    def self.make(x) = new(x)\n    def name?\n      if a then b.c else \"it's\" end\n    rescue Foo => e\n      log e, 1\n    end\n  end\nend\n",
    )
    assert symbols == {("Zoo", "module", None), ("Car", "class", "Zoo"), ("initialize", "method", "Car"), ("make", "method", "Car"), ("name?", "method", "Car")}
    assert {("Vehicle", "extends", "Base", None), ("helper", "call", None, 2), ("each", "call", "rest", 0), ("weigh", "call", "r", 1), ("log", "call", None, 2)} <= refs
    assert {"a", "b", "rest", "total", "r", "s", "e"} <= locals_of(f)


def test_python():
    f, symbols, refs = parse("python", "import pkg.mod, os.path as p\nfrom .a import b as c\nclass Dog(Animal, meta=M):\n    @staticmethod\n    def make(a, /, b, *, k=1, **more):\n        return wrap(a).go(b)\n    def _x(self): pass\n    def __y(self): pass\n")
    by = {s["name"]: s for s in f["symbols"]}
    assert (by["make"]["is_static"], by["make"]["param_count"], by["make"]["variadic"]) == (True, 6, True) and by["_x"]["visibility"] == "protected" and by["__y"]["visibility"] == "private" and by["_x"]["param_count"] == 1
    assert [(i["kind"], i["source"], i["local_name"]) for i in f["imports"]] == [("namespace", "pkg.mod", "pkg"), ("namespace", "os.path", "p"), ("named", ".a", "c")]
    assert {("Animal", "extends", None, None), ("go", "call", "wrap(a)", 1), ("wrap", "call", None, 1)} <= refs and ("M", "extends", None, None) not in refs
