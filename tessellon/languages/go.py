"""Go."""

from tessellon.languages.base import Language, words

LANGUAGE = Language(
    name="go",
    extension=".go",
    comments=(r"//[^\n]*", r"/\*.*?\*/"),
    strings=(r"`[^`]*`", r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])+'"),
    type_first=False,
    structural=words(
        "append any bool break byte cap case chan clear close comparable complex64 complex128 const continue copy default defer delete else error fallthrough false float32 float64 for func go goto if "
        "imag import int int8 int16 int32 int64 interface iota len make map max min new nil package panic print println range real recover return rune select string struct switch true type uint uint8 "
        "uint16 uint32 uint64 uintptr var fmt os io log strings strconv errors context time sync http json testing err ctx main init Error String"
    ),
    # Expressions for boilerplate.
    candidates=(
        r"import\s+\(",
        r"package\s+\w+",
        r"if\s+err\s*!=\s*nil\s*\{",
        r"return\s+(?:nil,\s*)?(?:err|nil|fmt\.Errorf\([^)\n]*\))",
        r"if\s+err\s*:?=\s*[^;\n]+;\s*err\s*!=\s*nil\s*\{",
        r"func\s+\(\w+\s+\*?\w+\)\s+\w+\([^)\n]*\)",
        r"func\s+\w+\([^)\n]{0,80}\)(?:\s*\(?[\w*, .\[\]]+\)?)?\s*\{",
        r"type\s+\w+\s+(?:struct|interface)\s*\{",
        r"go\s+func\(",
        r"defer\s+\w+(?:\.\w+)*\(",
        r"(?:make|chan|<-chan)\s*\(?\s*(?:chan|map|\[\])?\s*\w*",
        r"ctx\s+context\.Context",
        r"context\.(?:Background|TODO|WithCancel|WithTimeout)\(",
        r"fmt\.(?:Printf|Println|Sprintf|Errorf|Fprintf)\(",
        r"log\.(?:Printf|Println|Fatal|Fatalf|Print)\(",
        r"os\.(?:Exit|Getenv|Open|Args)\b",
        r"http\.\w+",
        r"t\.(?:Fatal|Fatalf|Error|Errorf|Run|Helper|Log|Logf)\(",
        r"for\s+_?\w*,?\s*\w+\s*:=\s*range\s+",
        r"sync\.(?:Mutex|RWMutex|WaitGroup|Once)",
        r"\.(?:Lock|Unlock|RLock|RUnlock|Wait|Done|Add)\(\w*\)",
        r"map\[\w+\](?:\w+|\[\]\w+|interface\{\})",
        r"strings\.\w+\(",
        r"switch\s+\w+(?:\.\(type\))?\s*\{",
    ),
    # Where a dictionary starts.
    seeds=tuple((p, c) for c, ps in {
        "error": ("if err != nil {", "return err", "return nil, err", "return fmt.Errorf(", "errors.New(", "errors.Is(err, ", "errors.As(err, ", "!= nil {", "== nil {"),
        "import": ('"fmt"', '"os"', '"context"', '"strings"', '"time"', '"testing"', "import ("),
        "function": ("func main() {", "func (s *", "func (c *", "func New", "func Test", "func init() {"),
        "type": ("type ", " struct {", " interface {", "interface{}"),
        "context": ("ctx context.Context", "context.Background()", "context.WithCancel(", "context.WithTimeout(", "ctx.Done()"),
        "concurrency": ("go func() {", "defer func() {", "sync.Mutex", "sync.WaitGroup", "make(chan ", "wg.Add(1)", "wg.Done()", "mu.Lock()", "defer mu.Unlock()"),
        "format": ("fmt.Println(", "fmt.Printf(", "fmt.Sprintf(", "fmt.Fprintf("),
        "logging": ("log.Printf(", "log.Fatal(", "log.Println("),
        "http": ("http.ResponseWriter", "*http.Request", "http.StatusOK", "http.Error(w, ", "http.HandleFunc("),
        "test": ("(t *testing.T) {", "t.Fatalf(", "t.Errorf(", "t.Run(", "t.Helper()", "require.NoError(t, err)", "assert.Equal(t, "),
        "expression": ("make(map[string]", "append(", "range ", "defer ", "map[string]string", "map[string]interface{}", ":= range "),
        "tag": ("`json:", ",omitempty", "`yaml:"),
    }.items() for p in ps),
)
