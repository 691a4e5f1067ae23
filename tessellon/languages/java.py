"""Java."""

from tessellon.languages.base import Language, words

LANGUAGE = Language(
    name="java",
    extension=".java",
    comments=(r"//[^\n]*", r"/\*.*?\*/"),
    strings=(r'""".*?"""', r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])+'"),
    is_safe=lambda token, text, start: token.startswith("/**"),
    ident=r"[a-zA-Z_$][\w$]*",
    structural=words(
        "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native "
        "new null package private protected public record return sealed short static strictfp super switch synchronized this throw throws transient true try false var void volatile while yield "
        "String Object Integer Long Boolean List Map Set Optional Exception Override System Math Collectors Arrays Collections main toString equals hashCode"
    ),
    # Expressions for boilerplate.
    candidates=(
        r"import\s+(?:static\s+)?[\w.]+(?:\.\*)?;",
        r"package\s+[\w.]+;",
        r"@[A-Z]\w*(?:\([^)\n]*\))?",
        r"(?:public|private|protected)\s+(?:static\s+|final\s+|abstract\s+|synchronized\s+)*(?:class|interface|enum|void|int|long|boolean|String)\b",
        r"public\s+static\s+void\s+main\(String\[\]\s+args\)",
        r"public\s+\w+(?:<\w+>)?\s+(?:get|set|is)\w+\([^)\n]*\)",
        r"throw\s+new\s+\w+Exception\([^)\n]*\);",
        r"catch\s*\(\w+(?:\s*\|\s*\w+)*\s+\w+\)",
        r"(?:List|Map|Set|Optional|Collection|Iterator)<[\w, <>?]+>",
        r"new\s+(?:ArrayList|HashMap|HashSet|LinkedList)<[^>\n]*>\(\)",
        r"\.(?:stream|map|filter|collect|forEach|orElse|isPresent|toString|equals|hashCode)\(",
        r"log(?:ger)?\.(?:trace|debug|info|warn|error)\(",
        r"return\s+(?:this|null|true|false|\w+\.\w+\(\));",
        r"if\s*\(\w+\s*[!=]=\s*null\)",
        r"\*\s*@(?:param|return|throws|see|since|author)[^\n]*",
        r"try\s*\(\w+(?:<\w+>)?\s+\w+\s*=\s*",
        r"assert(?:Equals|True|False|Null|NotNull|That|Throws)\(",
        r"(?:verify|when|mock)\(",
        r"this\.\w+\s*=\s*\w+;",
        r"System\.(?:out|err)\.print(?:ln|f)?\(",
        r"private\s+(?:static\s+)?final\s+\w+(?:<[^>\n]+>)?\s+\w+",
        r"implements\s+\w+(?:<\w+>)?",
        r"for\s*\(\w+(?:<\w+>)?\s+\w+\s*:\s*",
    ),
    # Where a dictionary starts.
    seeds=tuple((p, c) for c, ps in {
        "import": ("import java.util.List;", "import java.util.Map;", "import java.util.ArrayList;", "import java.util.HashMap;", "import java.io.IOException;", "import org.junit.Test;", "import static org.junit.Assert.", "import org.slf4j.Logger;", "import javax."),
        "annotation": ("@Override", "@Deprecated", "@Nullable", "@SuppressWarnings(", "@Test", "@Before", "@Autowired", "@Inject", "@Service", "@Component", "@Entity", "@Column(", "@JsonProperty(", "@GetMapping(", "@RequestMapping("),
        "modifier": ("public static final String ", "private static final ", "private final ", "public static void main(String[] args)"),
        "exception": ("throw new IllegalArgumentException(", "throw new IllegalStateException(", "throw new NullPointerException(", "throw new UnsupportedOperationException(", "throws IOException", "catch (Exception e)", "catch (IOException e)", "throw new RuntimeException("),
        "expression": ("System.out.println(", "new ArrayList<>()", "new HashMap<>()", "Objects.requireNonNull(", "instanceof ", "return this;", "public String toString()", "public int hashCode()", "public boolean equals(Object "),
        "stream": (".stream()", ".collect(Collectors.toList())", ".map(", ".filter(", ".forEach("),
        "javadoc": ("@param ", "@return ", "@throws ", "{@link ", "{@code ", "{@inheritDoc}"),
        "logging": ("private static final Logger ", "LoggerFactory.getLogger(", "logger.info(", "logger.debug(", "logger.warn(", "logger.error("),
        "test": ("assertEquals(", "assertTrue(", "assertFalse(", "assertNotNull(", "assertThat("),
    }.items() for p in ps),
)
