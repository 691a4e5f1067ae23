"""TypeScript."""

from tessellon.languages.base import Language, words

LANGUAGE = Language(
    name="typescript",
    extension=".ts",
    extensions=(".ts", ".tsx"),
    comments=(r"//[^\n]*", r"/\*.*?\*/"),
    strings=(r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"`(?:\\.|[^`\\])*`"),
    is_safe=lambda token, text, start: token.startswith("/**") and "@license" not in token,
    ident=r"[a-zA-Z_$][\w$]*",
    type_first=False,
    structural=words(
        "abstract any as asserts async await bigint boolean break case catch class const constructor continue debugger declare default delete do else enum export extends false finally for from function "
        "get if implements import in infer instanceof interface is keyof let module namespace never new null number object of package private protected public readonly require return satisfies set "
        "static string super switch symbol this throw true try type typeof undefined unique unknown var void while with yield "
        "Array Promise Record Partial Map Set Error Date Math JSON Object console window document React useState useEffect describe it expect"
    ),
    # Expressions for boilerplate.
    candidates=(
        r"import\s+(?:type\s+)?\{[^}\n]*\}\s+from\s+",
        r"import\s+\*\s+as\s+\w+\s+from\s+",
        r"export\s+(?:default\s+)?(?:async\s+)?(?:const|function|class|interface|type|enum)\b",
        r":\s*(?:string|number|boolean|any|void|unknown)(?:\[\])?",
        r"(?:Promise|Array|Record|Partial|Map|Set)<[\w, \[\]|<>]+>",
        r"const\s+\[\w+,\s*set\w+\]\s*=\s*useState",
        r"use(?:State|Effect|Memo|Callback|Ref|Context)\(",
        r"@\w+\([^)\n]*\)",
        r"async\s+\w*\([^)\n]*\)",
        r"await\s+\w+(?:\.\w+)*\(",
        r"throw\s+new\s+\w*Error\(",
        r"\([^()\n]{0,60}\)\s*=>",
        r"console\.(?:log|warn|error|info|debug)\(",
        r"(?:describe|it|test|beforeEach|afterEach)\(",
        r"expect\([^)\n]*\)\.\w+",
        r"\*\s*@(?:param|returns?|throws|example|deprecated)[^\n]*",
        r"\?\.\w+",
        r"as\s+(?:const|any|unknown|string|number)",
        r"\.(?:map|filter|reduce|forEach|find|push|join|slice|then|catch)\(",
        r"(?:private|public|protected)\s+(?:readonly\s+)?\w+",
        r"return\s+(?:null|undefined|true|false|this\.\w+);?",
        r"if\s*\(!?\w+(?:\.\w+)*\)",
        r"(?:const|let)\s+\{[^}\n]*\}\s*=",
    ),
    # Where a dictionary starts.
    seeds=tuple((p, c) for c, ps in {
        "import": ("import React from ", "import { ", " } from ", "import * as ", "import type { ", "from 'react'", "from '@angular/core'"),
        "export": ("export default ", "export const ", "export function ", "export interface ", "export class ", "export type "),
        "type": (": string", ": number", ": boolean", ": void", "Promise<void>", "Record<string, ", "Partial<", "readonly "),
        "react": ("useState(", "useEffect(() => {", "useCallback(", "useMemo(() => ", "React.FC<", "className=", "onClick={"),
        "async": ("async function ", "await ", "Promise.all(", ".then(", "new Promise("),
        "error": ("throw new Error(", "catch (error) {", "catch (e) {", "} finally {"),
        "logging": ("console.log(", "console.error(", "console.warn("),
        "test": ("describe(", "it('should ", "expect(", ".toBe(", ".toEqual(", "beforeEach(() => {", "jest.fn()"),
        "jsdoc": ("@param ", "@returns ", "@deprecated", "@example", "@internal"),
        "expression": ("=> {", "return null;", "=== undefined", "!== undefined", "typeof ", "Object.keys(", "JSON.stringify("),
    }.items() for p in ps),
)
