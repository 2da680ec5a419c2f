"""The rule catalog: what each rule is called and means, and where it looks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    """A rule. Line rules also say which lines they look at and what must match there.

    region: ``script``, ``instance``, ``template`` (not in a script), ``outer`` (not in an instance
    script), ``markup`` (neither script nor style), ``style``; empty: anywhere. column: a pattern whose
    first match is the position, ``=text`` for the place of a literal, empty for 1. group: a pattern
    whose first group is put into the message at ``{}``.
    """

    name: str
    category: str
    severity: str
    message: str
    line: bool = True
    runes: bool = False
    kit: bool = False
    typescript: bool = False
    component: bool = False
    region: str = ""
    comments: bool = False
    need: tuple[str, ...] = ()
    forbid: tuple[str, ...] = ()
    path_need: tuple[str, ...] = ()
    path_forbid: tuple[str, ...] = ()
    column: str = ""
    in_string: bool = True
    group: str = ""


_IMPORT_TYPE = r"import\s+type[\s{]"
_TEST = r"\.(test|spec)\.(ts|js|svelte)$"

#: What a finding of each rule advises.
HELP = {
    "no-legacy-reactive": 'Replace `$:` blocks with `$derived()` for computed values or `$effect()` for side effects',
    "no-legacy-lifecycle": 'Replace `onMount`, `onDestroy`, `beforeUpdate`, and `afterUpdate` with `$effect()`',
    "no-export-let": 'Use `let { prop1, prop2 } = $props()` instead of `export let`',
    "no-event-dispatcher": 'Use callback props instead by passing functions via `$props()` and calling them directly.',
    "no-legacy-slots": 'Use `{@render children()}` or `{@render slotName()}` instead of `<slot>`',
    "no-let-directive": 'The `let:` directive is removed in Svelte 5 so use snippet props with `{@render}` blocks instead.',
    "no-on-directive": 'Use `onclick`, `onchange`, etc. instead of `on:click`, `on:change`',
    "no-effect-for-derived": 'Replace `$effect(() => { x = expr })` with `const x = $derived(expr)` for better reactivity tracking and fewer re-runs.',
    "each-missing-key": 'Add a key expression like `{#each items as item (item.id)}` so Svelte can efficiently diff list updates instead of re-creating DOM nodes.',
    "no-inline-object": 'Extract the value into a `$derived` or a module-level constant to avoid allocating a new reference each render cycle.',
    "no-transition-all": 'Replace `transition: all` with explicit properties like `transition: opacity 0.2s, transform 0.2s` to reduce layout and paint cost.',
    "no-giant-component": 'Large components are harder to maintain and test. Extract logical sections into child components or shared utilities.',
    "no-deep-nesting": 'Extract nested sections into separate components to improve readability.',
    "no-console": 'Remove console statements before shipping. Use a structured logger if runtime logging is needed.',
    "no-multi-script": 'Merge duplicate <script> blocks into a single one. Use <script context="module"> (Svelte 4) or <script module> (Svelte 5) only for module-level exports.',
    "no-unsafe-html": 'Avoid `{@html}` with untrusted data. Sanitize content with a library like `dompurify` before rendering, or restructure to avoid raw HTML injection entirely.',
    "no-secrets": 'Move secrets to environment variables and access them through `$env/static/private` or a server-side `.env` file. Never commit secrets to source control.',
    "no-eval": 'Remove `eval()` and use safer alternatives like `JSON.parse()` for data, or structured alternatives for dynamic logic. `eval` is a common code injection vector.',
    "no-public-env-secrets": 'Use `$env/static/private` or `$env/dynamic/private` for secrets. Public env vars are bundled into the client and visible to anyone who inspects the page.',
    "no-client-fetch": 'Move data fetching to `+page.ts` / `+page.server.ts` load functions, or use form actions for mutations.',
    "load-missing-type": 'Add a type annotation like `export const load: PageLoad = ...` or use `satisfies PageLoad` for full type inference.',
    "no-goto-external": "SvelteKit's `goto()` is designed for internal navigation. Use `window.location.href` or an `<a>` tag for external redirects.",
    "form-action-no-validation": 'Validate form data with a schema library (zod, valibot, yup, joi, arktype) or manual type checks (typeof, instanceof) before using it.',
    "missing-error-page": 'Create `src/routes/+error.svelte` to provide a custom error page for your users.',
    "no-barrel-import": "Import from the specific file: `import { Button } from './components/Button'` instead of `./components` or `./components/index`. Barrel files prevent tree-shaking and inflate bundle size.",
    "no-full-lodash": "Import the specific function: `import debounce from 'lodash/debounce'` or use `lodash-es` for tree-shaking. A full `lodash` import adds ~70kb to your bundle.",
    "no-moment": "Replace with `import { format } from 'date-fns'` (tree-shakeable, ~13kb per function) or `import dayjs from 'dayjs'` (2kb). Both are actively maintained.",
    "no-full-icon-import": "Replace `import * as Icons from 'phosphor-svelte'` with individual named imports: `import { House, User } from 'phosphor-svelte'`. Wildcard imports prevent tree-shaking and bundle every icon in the set.",
    "img-missing-alt": 'Add descriptive alt text: `<img alt="description" />`. For decorative images use `alt=""`. Dynamic bindings like `{alt}` or `alt={altVar}` are accepted.',
    "click-needs-keyboard": 'Add an `onkeydown` handler and `role="button"` + `tabindex="0"` for non-interactive elements with click handlers. Or better: use a `<button>` instead.',
    "anchor-no-content": 'Add text content, `aria-label`, or `aria-labelledby` to `<a>` elements so screen readers can announce the link purpose.',
    "no-unnecessary-state": 'If a value never changes, use a plain `let` or `const` instead of `$state()`. Wrapping non-reactive values in `$state` adds overhead for nothing',
    "no-derived-side-effect": 'Move side effects out of `$derived` and into `$effect`. Derived values should only compute and return, never mutate external state or call impure functions',
    "prefer-runes": 'In Svelte 5, `$state` replaces `writable`, `$derived` replaces `derived`, and fine-grained reactivity makes stores unnecessary for most cases',
}

#: Names, categories, severities, messages and patterns are fixed values: results must carry just these.
RULES: tuple[Rule, ...] = (
    Rule("no-legacy-reactive", "Correctness", "error", "Legacy `$:` reactive statement detected in a Svelte 5 project",
         runes=True, component=True, region="instance", need=(r"^\s*\$:\s",)),
    Rule("no-legacy-lifecycle", "Correctness", "error", "Legacy lifecycle import detected in a Svelte 5 project",
         runes=True, need=(r"""import\s+\{[^}]*(onMount|onDestroy|beforeUpdate|afterUpdate)[^}]*\}\s+from\s+['"]svelte['"]""",), forbid=(_IMPORT_TYPE,),
         column=r"""import\s+\{[^}]*(onMount|onDestroy|beforeUpdate|afterUpdate)[^}]*\}\s+from\s+['"]svelte['"]"""),
    Rule("no-export-let", "Correctness", "error", "Legacy `export let` prop declaration detected in a Svelte 5 project",
         runes=True, component=True, region="instance", need=(r"^\s*export\s+let\s+\w",)),
    Rule("no-event-dispatcher", "Correctness", "error", "`createEventDispatcher` is deprecated in Svelte 5",
         runes=True, need=(r"createEventDispatcher",), forbid=(_IMPORT_TYPE,), column=r"createEventDispatcher"),
    Rule("no-legacy-slots", "Correctness", "error", "Legacy `<slot>` element detected in a Svelte 5 project",
         runes=True, component=True, region="outer", need=(r"<slot(?:\s|\/?>)",), column=r"<slot(?:\s|\/?>)"),
    Rule("no-let-directive", "Correctness", "error", "Legacy `let:` directive detected in a Svelte 5 project",
         runes=True, component=True, region="outer", need=(r"\slet:\w+",), column=r"\slet:\w+"),
    Rule("no-on-directive", "Correctness", "warning", "Legacy `on:` event directive detected in a Svelte 5 project",
         runes=True, component=True, region="outer", need=(r"\bon:\w+",), column=r"\bon:\w+"),
    Rule("no-effect-for-derived", "Performance", "warning", "$effect used to derive a single value — use $derived instead", line=False, component=True),
    Rule("each-missing-key", "Performance", "warning", "{#each} block is missing a key expression",
         component=True, region="template", comments=True, need=(r"\{#each\s", r"\{#each\s+.+\s+as\s+[^(]+\}"), forbid=(r"\{#each\s+.+\s+as\s+.+\(.+\)\s*\}",), column="={#each"),
    Rule("no-inline-object", "Performance", "warning", "Inline object or array literal in template expression causes re-creation on every render",
         component=True, region="markup", need=(r"\{(?:[^{}#/:@!][^{}]*)?\b\w+\s*\(\s*(?:\{[^}]*\w+\s*:|(?:\[[^\]]*\]))",)),
    Rule("no-transition-all", "Performance", "warning", "`transition: all` is expensive — specify individual properties instead.",
         region="style", comments=True, need=(r"transition\s*:\s*all[\s;,]",), column=r"transition\s*:\s*all[\s;,]"),
    Rule("no-giant-component", "Architecture", "warning", "Component has {} meaningful lines (limit: 300). Consider breaking it into smaller components.", line=False, component=True),
    Rule("no-deep-nesting", "Architecture", "warning", "Block nesting depth is {} (max: 3).", line=False, component=True),
    Rule("no-console", "Architecture", "warning", "console.{}() left in source file.",
         need=(r"\bconsole\.(log|debug|warn|error|info|table|dir|trace|group|groupEnd|time|timeEnd)\s*\(",), path_need=(r"\.(svelte|ts|js)$",),
         path_forbid=(r"\.(test|spec)\.(ts|js)$", r"\blogger\b|\blogging\b", r"cli\.(ts|js)$"),
         column=r"\bconsole\.(log|debug|warn|error|info|table|dir|trace|group|groupEnd|time|timeEnd)\s*\(",
         group=r"\bconsole\.(log|debug|warn|error|info|table|dir|trace|group|groupEnd|time|timeEnd)\s*\("),
    Rule("no-multi-script", "Architecture", "warning", "Found {} instance <script> blocks — expected at most 1.", line=False, component=True),
    Rule("no-unsafe-html", "Security", "error", "Usage of `{@html}` detected — this is an XSS risk",
         component=True, region="template", need=(r"\{@html\s",), column=r"\{@html\s"),
    Rule("no-secrets", "Security", "error", "Possible hardcoded secret or API key detected", line=False),
    Rule("no-eval", "Security", "error", "Usage of `eval()` detected — allows arbitrary code execution",
         need=(r"\beval\s*\(",), forbid=(r"\bvm\s*\.\s*(?:runInContext|runInNewContext|runInThisContext|Script)\b",), path_forbid=(_TEST,), column=r"\beval\s*\(", in_string=False),
    Rule("no-public-env-secrets", "Security", "error", "Sensitive environment variable imported from a public `$env` module", line=False, kit=True),
    Rule("no-client-fetch", "SvelteKit", "warning", "Avoid `fetch()` in component scripts — use SvelteKit `load` functions or form actions instead.", line=False, kit=True, component=True),
    Rule("load-missing-type", "SvelteKit", "warning", "Load function is missing a type annotation or `satisfies` clause",
         typescript=True, comments=True, path_need=(r"\+(page|layout)\.(ts|server\.ts|js|server\.js)$",), path_forbid=(r"\.js$",),
         need=(r"export\s+(const|function)\s+load\b",), forbid=(r"export\s+(?:const|function)\s+load\b[^\n]*:\s*\w+", r"satisfies"), column="=load"),
    Rule("no-goto-external", "SvelteKit", "warning", "`goto()` should not be used with external URLs",
         kit=True, need=(r"""\bgoto\s*\(\s*['"`]https?:\/\/""",), column=r"""\bgoto\s*\(\s*['"`]https?:\/\/"""),
    Rule("form-action-no-validation", "SvelteKit", "warning", "Form action reads `formData` without apparent input validation", line=False),
    Rule("missing-error-page", "SvelteKit", "warning", "No root `+error.svelte` page found — unhandled errors will show SvelteKit's default error page.", line=False, kit=True),
    Rule("no-barrel-import", "Bundle Size", "warning", "Barrel import detected — import from the direct file path instead", line=False),
    Rule("no-full-lodash", "Bundle Size", "warning", "Full lodash import detected — import specific functions instead",
         need=(r"""from\s+['"]lodash['"]""",)),
    Rule("no-moment", "Bundle Size", "warning", "`moment.js` is heavy (~300kb) and unmaintained — use `date-fns` or `dayjs` instead",
         need=(r"""from\s+['"]moment['"]""",)),
    Rule("no-full-icon-import", "Bundle Size", "warning", "Top-level icon package import detected — import individual icons instead",
         need=(r"""import\s+\*\s+as\s+\w+\s+from\s+['"](?:phosphor-svelte|@phosphor-icons\/svelte|lucide-svelte|heroicons\/svelte)['"]""",),
         column=r"""import\s+\*\s+as\s+\w+\s+from\s+['"](?:phosphor-svelte|@phosphor-icons\/svelte|lucide-svelte|heroicons\/svelte)['"]""", in_string=False),
    Rule("img-missing-alt", "Accessibility", "warning", "`<img>` element is missing an `alt` attribute", line=False, component=True),
    Rule("click-needs-keyboard", "Accessibility", "warning", "Click handler on non-interactive element needs keyboard support", line=False, component=True),
    Rule("anchor-no-content", "Accessibility", "warning", "Anchor tag has no accessible label", line=False, component=True),
    Rule("no-unnecessary-state", "State & Reactivity", "warning", "`{}` is wrapped in `$state` but never mutated or reassigned", line=False, component=True),
    Rule("no-derived-side-effect", "State & Reactivity", "error", "`$derived` should be a pure computation — side effects are not allowed.", line=False),
    Rule("prefer-runes", "State & Reactivity", "warning", "Svelte store (`writable`/`readable`/`derived` from `svelte/store`) detected — consider using runes.",
         runes=True, comments=True, need=(r"""from\s+['"]svelte\/store['"]""",), forbid=(_IMPORT_TYPE,)),
)

BY_NAME = {r.name: r for r in RULES}


def catalog(spark: SparkSession) -> DataFrame:
    """name, category, severity, message, help of the built-in rules: a small table for broadcast joins."""
    return spark.createDataFrame([(r.name, r.category, r.severity, r.message, HELP[r.name]) for r in RULES], "rule string, category string, severity string, message string, help string")
