"""Logical inputs of the reference, derived by Spark from the driver tables.

The reference reads change requests, snapshots, annotations and
predictions that are not part of the test data; each function here builds
one of them from a driver table with plain column expressions, so its size
grows with the table. ``quarry.plans.oracle`` spells the same derivations
in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.split import with_group_index
from quarry.session import read_table, spread


def _s(c) -> F.Column:
    return F.col(c).cast("string")


# Rows of a driver table per release: a snapshot is a repository at one
# release, so its size stays bounded while the number of snapshots grows.
RELEASE_ROWS = 1000
# Source files that a task writes or parses, at most.
MODULES_OF_TASK = 20_000


def _release(row_id: str) -> F.Column:
    return F.floor(F.col(row_id) / RELEASE_ROWS).cast("string")


def change_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change request per ``part`` row; snapshot = brand at a release.

    The patch holds the cases the label regexes must keep or miss: a hunk
    header, removed / added / typed / multi-line defs, a class with and one
    without a base list, and a def inside another word.
    """
    part = read_table(spark, sf_dir, "part")
    fname = F.regexp_replace("p_name", " ", "_")
    w1 = F.split("p_name", " ").getItem(0)
    w2 = F.split("p_name", " ").getItem(1)
    patch = F.concat_ws(
        "\n",
        F.concat(F.lit("@@ -1,3 +1,4 @@ def "), w1, F.lit("(self):")),
        F.concat(F.lit("-    def "), fname, F.lit("(a):")),
        F.concat(F.lit("+    def "), fname, F.lit("_v"), _s("p_size"), F.lit("(a, b):")),
        F.concat(F.lit("+    def typed_"), fname, F.lit("(x) -> int:")),
        F.concat(F.lit("+class "), F.col("p_type"), F.lit("(Base):")),
        F.concat(F.lit("+class Plain"), _s("p_size"), F.lit(":")),
        F.concat(F.lit("+def multi_"), fname, F.lit("(")),
        F.lit("+    a):"),
        F.concat(F.lit("+ undef "), w2, F.lit("(x):")),
    )
    return part.select(
        F.col("p_partkey").alias("request_id"),
        F.concat(F.lit("acme/"), F.lower(F.regexp_replace("p_brand", "#", ""))).alias("repo"),
        F.md5(F.concat("p_brand", F.lit(":"), _release("p_partkey"))).alias("base_commit"),
        patch.alias("patch"),
        F.concat(F.lit("Fix "), F.col("p_name"), F.lit(" handling for "), F.col("p_type"),
                 F.lit(" parts of size "), _s("p_size")).alias("problem_statement"),
    )


def snapshot_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of each snapshot: one function and one class per
    part row, located in file ``mod<size>.py`` at line ``p_partkey``."""
    part = read_table(spark, sf_dir, "part")
    sp = F.concat(F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("_"),
                  F.md5(F.concat("p_brand", F.lit(":"), _release("p_partkey"))))
    file = F.concat(F.lit("mod"), _s("p_size"), F.lit(".py"))
    funcs = part.select(sp.alias("save_path"), file.alias("file"), F.lit("function").alias("kind"),
                        F.regexp_replace("p_name", " ", "_").alias("name"),
                        F.concat(F.lit("    return "), _s("p_partkey")).alias("body"),
                        F.col("p_partkey").cast("int").alias("start_line"))
    classes = part.select(sp.alias("save_path"), file.alias("file"), F.lit("class").alias("kind"),
                          F.col("p_type").alias("name"),
                          F.concat(F.lit("    size = "), _s("p_size")).alias("body"),
                          F.col("p_partkey").cast("int").alias("start_line"))
    return funcs.unionByName(classes)


def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored label text per request, as the reference writes it to CSV:
    a Python tuple of two lists; small parts have empty lists."""
    part = read_table(spark, sf_dir, "part")
    fname = F.regexp_replace("p_name", " ", "_")
    w1 = F.split("p_name", " ").getItem(0)
    funcs = F.when(F.col("p_size") <= 10, F.lit("[]")).otherwise(
        F.concat(F.lit("['"), fname, F.lit("', '"), w1, F.lit("']")))
    classes = F.when((F.col("p_size") > 40) | (F.col("p_size") <= 5), F.lit("[]")).otherwise(
        F.concat(F.lit("['"), F.col("p_type"), F.lit("']")))
    return part.select(F.col("p_partkey").alias("request_id"),
                       F.concat(F.lit("("), funcs, F.lit(", "), classes, F.lit(")")).alias("label_text"),
                       F.concat(F.lit("Fix "), F.col("p_name"), F.lit(" handling for "), F.col("p_type"),
                                F.lit(" parts of size "), _s("p_size")).alias("problem_statement"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance annotations: labelled documents, query = source."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    return (labels.join(docs.select("doc_id", "lang", "source"), "doc_id")
            .select(F.col("lang").alias("Language"), F.col("source").alias("Query"),
                    _s("doc_id").alias("GitHubUrl"), F.col("quality").alias("Relevance"),
                    F.lit("").alias("Notes")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked predictions: every document for its (language, source),
    longest first. The rank is a distributed group index, so a hot
    (language, source) group is not ranked inside one task."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", (-F.col("n_chars")).alias("neg_chars"))
    ranked = with_group_index(docs, ["lang", "source"], ["neg_chars", "doc_id"], "idx")
    return ranked.select(F.col("lang").alias("language"), F.col("source").alias("query"),
                         _s("doc_id").alias("url"), (F.col("idx") + 1).alias("rank"))


def issue_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for keyword matching: each document is an issue against the
    snapshot of its source at its release."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("request_id"),
                       F.concat("source", F.lit("@"), _release("doc_id")).alias("save_path"),
                       F.col("text").alias("problem_statement"))


def line_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag index: one tag per line of every document of a snapshot;
    name = first identifier of the line (or '')."""
    from quarry.functions.text import identifiers

    docs = read_table(spark, sf_dir, "documents")
    lines = docs.select(F.concat("source", F.lit("@"), _release("doc_id")).alias("save_path"), F.col("doc_id").cast("string").alias("path"),
                        F.posexplode(F.split("text", "\n", -1)).alias("pos", "pattern"))
    return lines.select("save_path", "path", (F.col("pos") + 1).cast("int").alias("line"),
                        F.coalesce(F.try_element_at(identifiers("pattern"), F.lit(1)), F.lit("")).alias("name"),
                        "pattern")


def python_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python module per ``part`` row (repo = brand): a class with a
    documented method and a test method, a documented function (short
    docstring for sizes above 25) and an undocumented one. PROMO parts
    live under ``tests/``; SMALL ones decorate the function, STANDARD ones
    have a comment above it, MEDIUM ones hold letters outside ASCII, LARGE
    ones indent with tabs, ECONOMY ones end lines with CR LF, and sizes above
    45 do not parse."""
    part = spread(read_table(spark, sf_dir, "part"), MODULES_OF_TASK)
    k, s = _s("p_partkey"), _s("p_size")
    doc = F.when(F.col("p_size") > 25, F.lit('    """Price."""')).otherwise(
        F.lit('    """Compute the retail price quickly."""'))
    content = F.concat_ws(
        "\n",
        F.lit("import os"), F.lit(""), F.lit(""),
        F.concat(F.lit("class "), F.col("p_type"), F.lit("Widget"), k, F.lit("(Base):")),
        F.concat(F.lit('    """Holds '), F.col("p_name"),
                 F.when(F.col("p_type") == "MEDIUM", F.lit(" größere — 部品")).otherwise(F.lit("")), F.lit(' parts."""')),
        F.lit(""),
        F.concat(F.lit("    def size_"), k, F.lit("(self):")),
        F.lit('        """Return the size of the part."""'),
        F.concat(F.lit("        total = "), s),
        F.lit("        return total"),
        F.lit(""),
        F.concat(F.lit("    def test_"), k, F.lit("(self):")),
        F.lit('        """A test method that is skipped."""'),
        F.lit("        return None"),
        F.lit(""), F.lit(""),
        # concat_ws leaves nulls out: only these two kinds have a line above.
        F.when(F.col("p_type") == "SMALL", F.lit("@cached")).when(F.col("p_type") == "STANDARD", F.lit("# priced by size")),
        F.concat(F.lit("def price_"), k, F.lit("(x):")),
        doc,
        F.lit("    # scale by the size"),
        F.concat(F.lit("    return x * "), s),
        F.lit(""), F.lit(""),
        F.concat(F.lit("def tiny_"), k, F.lit("():")),
        F.lit("    return 1"),
        F.when(F.col("p_size") > 45, F.lit("def broken_(:")),
        F.lit(""),
    )
    content = F.when(F.col("p_type") == "LARGE", F.replace(content, F.lit("    "), F.lit("\t"))) \
        .when(F.col("p_type") == "ECONOMY", F.replace(content, F.lit("\n"), F.lit("\r\n"))).otherwise(content)
    path = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("tests/test_mod_"), k, F.lit(".py"))) \
        .otherwise(F.concat(F.lit("pkg/mod_"), k, F.lit(".py")))
    return part.select(F.concat(F.lit("acme/"), F.lower(F.regexp_replace("p_brand", "#", ""))).alias("repo"),
                       path.alias("path"), content.alias("content"))


# One file per language: @K is the part's key, @S its size. Comments, strings
# and templates hold words and brackets that must not count.
FILES = {
    "STANDARD": ("src/part_@K.py", """class Part@K(Base):
    def price(self):
        return "class X:" * @S

    @cached
    def size(self):
        def inner(): pass
        return inner


def check@K(x): return {"def": x}
""", "def broken_(:\n"),
    "ECONOMY": ("src/part_@K.go", """package parts

// func hidden@K() {}
type Part@K struct {
	Size int // }
}

type (
	Shape@K interface{ Area() float64 }
)

func external@K(x int) int
func (p *Part@K) Price(x int) (interface{}, error) {
	label := "}" + `{` + string('}')
	return func() int { return x * @S }(), check(label)
}
func Map@K[T any](x T) map[string]struct{} { return nil }
""", "func broken() {\n"),
    "MEDIUM": ("src/main/Part@K.java", """package parts;

/* class Hidden@K { */
@Named("}")
public final class Part@K<T> extends Base<T> implements Priced, Sized {
  private final Runnable task = new Runnable() { public void run() { go(); } };
  Part@K(int x) { super(x); }
  @Override
  public <R> Map<String, R> price(int x) throws IOException, BadPrice {
    if (x > @S) { return "}"; } // }
    return null;
  }
  abstract int none();
  enum Kind { SMALL, LARGE; int rank() { return '}'; } }
}
""", "class Broken {\n"),
    "PROMO": ("lib/part_@K.php", """<html> function page() { </html>
<?php
function check@K($x, array $y = [1]): ?int { # }
  return "{$y["k"]} }" . @S;
}
abstract class Part@K extends Base {
  use Priced;
  public static function price(int $x) {
    $f = function () { return 1; };
    return <<<TEXT
      } class Hidden {
      TEXT;
  }
  abstract protected function none();
}
?> } text <?php trait Priced@K { private function &cost() { return $this->cost; } }
""", "class Broken {\n"),
    "LARGE": ("lib/part_@K.rb", """# def hidden; end
module Parts@K
  class Part < Base::Part
    attr_reader :end, :class
    def initialize(size, rest = {})
      @size = size if rest
      rest.each do |x| puts "end #{x ? "end" : @S}" end
    end
    def self.price x, *rest
      while x do x.pop end
      <<~TEXT
        end def
      TEXT
    end
    def cost = @size / 2 / 3
    class << self
      def single; begin; 1; rescue; 2; end; end
    end
  end
end
def check@K(x) { if: x, end: %w[end def] } end
""", "def broken\n"),
    "SMALL": ("web/part_@K.js", """// function hidden@K() {}
export default async function check@K({ x } = {}) { return `a ${x ? `{${x}` : "}"} }`; }
const pattern = /[/}]{/g, half = @S / 2 / 3;
export class Part@K extends mixin(Base) {
  #size = 1;
  constructor(x) { super(x); }
  static async *price() { yield @S }
  get size() {
    return this.#size;
  }
  task = () => { class Inner { run() {} } };
}
if (half) { function* nested@K() { function deep() {} } }
""", "function broken() {\n"),
}


def language_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per ``part`` row, in one of six languages by the
    part's type; files of sizes above 45 end in a definition that breaks off."""
    part = spread(read_table(spark, sf_dir, "part"), MODULES_OF_TASK)

    def filled(text: str) -> F.Column:
        return F.replace(F.replace(F.lit(text), F.lit("@K"), _s("p_partkey")), F.lit("@S"), _s("p_size"))

    def by_type(value) -> F.Column:
        out = F.lit(None).cast("string")
        for kind, own in FILES.items():
            out = F.when(F.col("p_type") == kind, value(own)).otherwise(out)
        return out

    broken = F.when(F.col("p_size") > 45, by_type(lambda f: F.lit(f[2]))).otherwise("")
    return part.select(F.lower(F.regexp_replace("p_brand", "#", "")).alias("repo"), by_type(lambda f: filled(f[0])).alias("path"),
                       F.concat(by_type(lambda f: filled(f[1])), broken).alias("content"))


OLD_MODULE = """# priced by size
class Old@K(Base):
    \"\"\"Holds größere parts.\"\"\"
    def show(self, (x, y), mode=0755):
        \"\"\"Show the price of parts.\"\"\"
        print >>self.out, "price: %s" % `x`, @S
        try: exec self.code in self.space
        except (IOError, OSError), e:
            raise ValueError, "no price"
        return lambda (p, q): p <> 10L

def price@K(x):
    ur\"\"\"Compute the größte price quickly.\"\"\"
    if x: print "priced"  # now
    return x * @S
"""
BROKEN_CLASS = """class Half@K:
    def good@K(self, x):
        \"\"\"Return the size of it.\"\"\"
        return x
    def bad@K(self:
        \"\"\"Not a sound method here.\"\"\"
        return 2
    def fine@K(self):
        \"\"\"Print the size of parts.\"\"\"
        print self.size
def broken@K(:
"""


def old_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python module of the older grammar per ``part`` row; those of sizes
    above 45 end in a class and a function that break off."""
    part = spread(read_table(spark, sf_dir, "part"), MODULES_OF_TASK)
    text = F.concat(F.lit(OLD_MODULE), F.when(F.col("p_size") > 45, F.lit(BROKEN_CLASS)).otherwise(""))
    text = F.replace(F.replace(text, F.lit("@K"), _s("p_partkey")), F.lit("@S"), _s("p_size"))
    return part.select(F.lower(F.regexp_replace("p_brand", "#", "")).alias("repo"),
                       F.concat(F.lit("old/mod_"), _s("p_partkey"), F.lit(".py")).alias("path"), text.alias("content"))
