"""C#."""

from tessellon.languages.base import Language, words

LANGUAGE = Language(
    name="csharp",
    extension=".cs",
    comments=(r"//[^\n]*", r"/\*.*?\*/"),
    strings=(r'"""+.*?"""+', r'\$?@\$?"(?:[^"]|"")*"', r'\$?"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])+'"),
    is_safe=lambda token, text, start: token.startswith("///"),
    structural=words(
        "abstract as async await base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach "
        "get goto if implicit in init int interface internal is lock long nameof namespace new null object operator out override params partial private protected public readonly record ref return sbyte "
        "sealed set short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using value var virtual void volatile when where while yield "
        "Console Task String Object Exception List Dictionary IEnumerable Func Action Main ToString Equals GetHashCode Dispose"
    ),
    # Expressions for boilerplate.
    candidates=(
        r"using\s+[A-Z][\w.]*;",
        r"namespace\s+[A-Z][\w.]*",
        r"(?<![)\w])\[[A-Z]\w{2,}(?:\([^)\n]*\))?\]",
        r"\{\s*get;(?:\s*\w*\s*(?:set|init);)?\s*\}",
        r"(?:public|private|protected|internal)\s+(?:static\s+|sealed\s+|abstract\s+|virtual\s+|override\s+|async\s+|readonly\s+)*(?:class|interface|struct|enum|void|string|int|bool|Task(?:<\w+>)?)\b",
        r"(?:public|private|protected|internal)\s+(?:static\s+|override\s+|async\s+)*\w+(?:<\w+>)?\s+\w+\([^)\n]{0,80}\)",
        r"throw\s+new\s+\w+Exception\([^)\n]*\);",
        r"\?\?\s*throw\s+new\s+\w+\(",
        r"Console\.\w+\(",
        r"return\s+Task\.\w+",
        r"(?:I?List|IEnumerable|I?Dictionary|ICollection|Task|Func|Action|ILogger|IOptions)<",
        r"///\s*</?\w+[^>\n]*>",
        r"Assert\.\w+\(",
        r"string\.IsNullOr\w+\(",
        r"\.(?:ToList|ToArray|FirstOrDefault|Select|Where|Any|Count|ToString|Dispose)\(\)?",
        r"\.ConfigureAwait\(false\)",
        r"is\s+(?:not\s+)?null",
        r"where\s+\w+\s*:\s*\w+(?:\(\))?",
        r"#(?:region|endregion|pragma|if|endif)[^\n]*",
        r"CancellationToken\s+\w+",
        r"=\s*(?:string\.Empty|new\(\)|default);",
        r"foreach\s*\(var\s+\w+\s+in\s+",
        r"await\s+\w+(?:\.\w+)*\(",
        r":\s*I[A-Z]\w+(?:<\w+>)?",
    ),
    # Where a dictionary starts.
    seeds=tuple((p, c) for c, ps in {
        "using": ("using System;", "using System.Collections.Generic;", "using System.Linq;", "using System.Text;", "using System.IO;", "using System.Threading.Tasks;", "using Microsoft.Extensions.Logging;", "using Xunit;"),
        "property": ("{ get; set; }", "{ get; private set; }", "{ get; init; }", "{ get; }"),
        "modifier": ("public static void ", "public override string ToString()", "public override bool Equals(object", "public override int GetHashCode()", "private readonly ", "public abstract class ", "public sealed class ", "public static class ", "protected virtual "),
        "signature": ("static void Main(string[] args)", "public void Dispose()", "protected virtual void Dispose(bool disposing)", "public async Task<"),
        "exception": ("throw new ArgumentNullException(nameof(", "throw new ArgumentException(", "throw new InvalidOperationException(", "throw new NotImplementedException();", "throw new NotSupportedException("),
        "expression": ("Console.WriteLine(", "return Task.CompletedTask;", "= string.Empty;", "string.IsNullOrEmpty(", ".ConfigureAwait(false)", "nameof("),
        "attribute": ("[Fact]", "[Theory]", "[TestMethod]", "[Serializable]", "[Obsolete]", "[HttpGet]", "[HttpPost]", "[ApiController]"),
        "generic": ("IEnumerable<", "List<string>", "Dictionary<string, ", "ILogger<", "Task<IActionResult>"),
        "xmldoc": ("/// <summary>", "/// </summary>", "/// <returns>", "/// <param name=", "/// <inheritdoc />"),
    }.items() for p in ps),
)
