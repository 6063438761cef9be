"""Rule tables of the junk finder, as data (fixed values).

Artifact rules: id, title, names, name prefix, siblings (any), sibling suffixes (any), siblings (all), inside (any), lock files, caution, how to restore.
"""

_GRADLE = ("build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts")
_NONE: tuple = ()

ARTIFACTS = (
    ("node_modules", "Node.js packages", ("node_modules",), None, ("package.json",), _NONE, _NONE, _NONE, ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock", "npm-shrinkwrap.json"), None, "npm / yarn / pnpm install"),
    ("js-build", "JavaScript build cache", (".next", ".nuxt", ".output", ".svelte-kit", ".turbo", ".parcel-cache", ".angular", ".docusaurus", ".expo"), None, ("package.json",), _NONE, _NONE, _NONE, _NONE, None, "next build of the project"),
    ("rust-target", "Rust build output", ("target",), None, ("Cargo.toml",), _NONE, _NONE, (".rustc_info.json", "CACHEDIR.TAG", "debug", "release"), _NONE, None, "cargo build"),
    ("rust-target", "Rust build output", ("target",), None, _NONE, _NONE, _NONE, (".rustc_info.json",), _NONE, None, "cargo build"),
    ("maven-target", "Maven build output", ("target",), None, ("pom.xml",), _NONE, _NONE, ("classes", "test-classes", "maven-status", "maven-archiver", "generated-sources", "surefire-reports"), _NONE, None, "mvn package"),
    ("swiftpm-build", "SwiftPM build output", (".build",), None, ("Package.swift",), _NONE, _NONE, _NONE, _NONE, None, "swift build"),
    ("xcode-build", "Xcode build folder", ("build", "DerivedData"), None, _NONE, (".xcodeproj", ".xcworkspace"), _NONE, ("XCBuildData", "Build", "Index.noindex", "ModuleCache.noindex", "SourcePackages", "info.plist", "Debug", "Release", "Debug-iphoneos", "Release-iphoneos", "Debug-iphonesimulator", "Release-iphonesimulator"), _NONE, None, "next Xcode build"),
    ("cocoapods", "CocoaPods dependencies", ("Pods",), None, ("Podfile",), _NONE, _NONE, _NONE, ("Podfile.lock",), None, "pod install"),
    ("carthage", "Carthage dependencies", ("Carthage",), None, ("Cartfile",), _NONE, _NONE, _NONE, ("Cartfile.resolved",), None, "carthage bootstrap"),
    ("gradle-build", "Gradle build output", ("build",), None, _GRADLE, _NONE, _NONE, ("intermediates", "outputs", "generated", "tmp", "classes", "libs", "kotlin", "reports"), _NONE, None, "gradle build"),
    ("gradle-build", "Gradle build output", (".gradle", ".cxx"), None, _GRADLE, _NONE, _NONE, _NONE, _NONE, None, "gradle build"),
    ("flutter-build", "Flutter build output", ("build",), None, ("pubspec.yaml",), _NONE, _NONE, ("app", "ios", "macos", "web", "linux", "windows", "flutter_assets", "native_assets", ".last_build_id"), _NONE, None, "flutter pub get && flutter build"),
    ("flutter-build", "Flutter build output", (".dart_tool",), None, ("pubspec.yaml",), _NONE, _NONE, _NONE, _NONE, None, "flutter pub get && flutter build"),
    ("cmake-build", "CMake build folder", ("build",), None, ("CMakeLists.txt",), _NONE, _NONE, ("CMakeCache.txt",), _NONE, None, "cmake --build"),
    ("cmake-build", "CMake build folder", _NONE, "cmake-build-", ("CMakeLists.txt",), _NONE, _NONE, _NONE, _NONE, None, "cmake --build"),
    ("python-venv", "Python virtual environment", (".venv", "venv", "env", "virtualenv"), None, _NONE, _NONE, _NONE, ("pyvenv.cfg",), _NONE, "Anything installed or saved in it by hand is not brought back by a reinstall", "python -m venv, then reinstall requirements"),
    ("python-cache", "Python tool cache", (".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox"), None, _NONE, _NONE, _NONE, _NONE, _NONE, None, "next run of the tool"),
    ("php-vendor", "Composer dependencies", ("vendor",), None, ("composer.json",), _NONE, _NONE, ("autoload.php",), ("composer.lock",), None, "composer install"),
    ("dotnet-build", ".NET build output", ("obj",), None, _NONE, _NONE, _NONE, ("project.assets.json",), _NONE, None, "dotnet build"),
    ("dotnet-build", ".NET build output", ("bin",), None, _NONE, (".csproj", ".fsproj", ".vbproj"), ("obj",), _NONE, _NONE, None, "dotnet build"),
    ("zig-build", "Zig build output", ("zig-cache", ".zig-cache", "zig-out"), None, ("build.zig",), _NONE, _NONE, _NONE, _NONE, None, "zig build"),
    ("elixir-build", "Elixir build output", ("_build", "deps"), None, ("mix.exs",), _NONE, _NONE, _NONE, ("mix.lock",), None, "mix deps.get && mix compile"),
    ("haskell-build", "Haskell build output", (".stack-work", "dist-newstyle"), None, ("stack.yaml", "cabal.project"), (".cabal",), _NONE, _NONE, _NONE, None, "stack build / cabal build"),
    ("terraform", "Terraform providers", (".terraform",), None, _NONE, _NONE, _NONE, _NONE, _NONE, None, "terraform init"),
    ("unity-cache", "Unity project cache", ("Library", "Temp", "Obj", "Logs"), None, _NONE, _NONE, ("Assets", "ProjectSettings"), _NONE, _NONE, None, "reopening the project in Unity"),
    ("unreal-cache", "Unreal project cache", ("Intermediate", "DerivedDataCache"), None, _NONE, (".uproject",), _NONE, _NONE, _NONE, None, "reopening the project in Unreal"),
    ("godot-cache", "Godot project cache", (".godot",), None, ("project.godot",), _NONE, _NONE, _NONE, _NONE, None, "reopening the project in Godot"),
)
ARTIFACT_SCHEMA = (
    "rule_ord int, id string, title string, names array<string>, name_prefix string, siblings array<string>, sibling_suffixes array<string>, all_siblings array<string>, "
    "inside array<string>, lockfiles array<string>, caution string, restore string"
)

#: Categories by key in order, with their titles.
CATEGORIES = (
    ("projects", "Project build artifacts"), ("developer", "Developer tools"), ("packages", "Package manager caches"), ("system", "App caches & logs"), ("large", "Large app data"), ("trash", "Trash"),
)

_XCODE = "~/Library/Developer/Xcode/"
#: Known locations: id, category, title, paths (~ is home), safety, note, mode.
LOCATIONS = (
    ("app-cache", "system", "Cache", ("~/Library/Caches",), "safe", "Apps rebuild their caches when needed", "children"),
    ("tool-cache", "packages", "Cache", ("~/.cache",), "safe", "Tools rebuild their caches when needed", "children"),
    ("logs", "system", "Log files", ("~/Library/Logs",), "safe", "Old diagnostic logs", "contents"),
    ("xcode-derived-data", "developer", "Xcode DerivedData", (_XCODE + "DerivedData",), "safe", "Rebuilt on the next Xcode build", "contents"),
    ("xcode-device-support", "developer", "Xcode device support", tuple(f"{_XCODE}{x} DeviceSupport" for x in ("iOS", "watchOS", "tvOS", "xrOS")), "safe", "Re-created when a device is connected", "contents"),
    ("xcode-misc", "developer", "Xcode previews & documentation cache", (_XCODE + "UserData/Previews", _XCODE + "DocumentationCache", "~/Library/Developer/XCTestDevices"), "safe", "Rebuilt by Xcode", "contents"),
    ("xcode-archives", "developer", "Xcode archives", (_XCODE + "Archives",), "review", "Needed to re-export or symbolicate builds you shipped", "contents"),
    ("simulator-caches", "developer", "Simulator caches", ("~/Library/Developer/CoreSimulator/Caches",), "safe", "Rebuilt by the Simulator", "contents"),
    ("simulator-devices", "developer", "Simulator devices", ("~/Library/Developer/CoreSimulator/Devices",), "review", "Simulators with their apps and data. Gentler: xcrun simctl delete unavailable", "contents"),
    ("simulator-runtimes", "developer", "Simulator runtimes", ("/Library/Developer/CoreSimulator/Images",), "info", "Remove in Xcode › Settings › Components, or: xcrun simctl runtime delete", "contents"),
    ("npm-cache", "packages", "npm cache", ("~/.npm/_cacache", "~/.npm/_npx"), "safe", "npm re-downloads packages when needed", "contents"),
    ("yarn-cache", "packages", "Yarn Berry cache", ("~/.yarn/berry/cache",), "safe", "Yarn re-downloads packages when needed", "contents"),
    ("pnpm-store", "packages", "pnpm store", ("~/Library/pnpm/store",), "review", "Shared by every pnpm project. Gentler: pnpm store prune", "contents"),
    ("bun-cache", "packages", "Bun cache", ("~/.bun/install/cache",), "safe", "Bun re-downloads packages when needed", "contents"),
    ("cargo-cache", "packages", "Cargo registry & git cache", ("~/.cargo/registry", "~/.cargo/git"), "safe", "Cargo re-downloads crates when needed", "contents"),
    ("go-modules", "packages", "Go module cache", ("~/go/pkg/mod",), "safe", "Go re-downloads modules when needed", "contents"),
    ("gradle-cache", "packages", "Gradle caches", ("~/.gradle/caches", "~/.gradle/wrapper/dists", "~/.gradle/daemon"), "safe", "Gradle re-downloads dependencies when needed", "contents"),
    ("maven-repo", "packages", "Maven local repository", ("~/.m2/repository",), "review", "Re-downloaded when needed, except artifacts you installed locally (mvn install)", "contents"),
    ("cocoapods-repos", "packages", "CocoaPods spec repos", ("~/.cocoapods/repos",), "safe", "Restore: pod repo update", "contents"),
    ("pub-cache", "packages", "Dart & Flutter pub cache", ("~/.pub-cache",), "review", "Includes globally activated Dart tools", "contents"),
    ("conda-pkgs", "packages", "Conda package cache", tuple(f"~/{x}/pkgs" for x in ("miniconda3", "anaconda3", "miniforge3", "mambaforge")), "review", "Gentler: conda clean --all", "contents"),
    ("version-manager-cache", "packages", "nvm & pyenv download cache", ("~/.nvm/.cache", "~/.pyenv/cache"), "safe", "Downloaded installers", "contents"),
    ("android-avd", "large", "Android emulators", ("~/.android/avd",), "review", "Virtual devices with their data", "contents"),
    ("android-system-images", "large", "Android system images", ("~/Library/Android/sdk/system-images",), "review", "Re-download in Android Studio's SDK Manager", "contents"),
    ("ios-backups", "large", "iPhone & iPad backups", ("~/Library/Application Support/MobileSync/Backup",), "review", "Local device backups. Manage in Finder › your device › Manage Backups", "contents"),
    ("ios-updates", "large", "iOS update files", ("~/Library/iTunes/iPhone Software Updates", "~/Library/iTunes/iPad Software Updates"), "safe", "Already-installed firmware downloads", "contents"),
    ("ollama-models", "large", "Ollama models", ("~/.ollama/models",), "review", "Gentler: ollama rm <model>", "contents"),
    ("lmstudio-models", "large", "LM Studio models", ("~/.lmstudio/models",), "review", "Downloaded model weights", "contents"),
    ("docker", "large", "Docker disk image", ("~/Library/Containers/com.docker.docker/Data/vms",), "info", "Reclaim with: docker system prune -a --volumes", "contents"),
    ("orbstack", "large", "OrbStack data", ("~/Library/Group Containers/HUAQ24HBR6.dev.orbstack/data", "~/.orbstack"), "info", "Reclaim with: docker system prune -a --volumes", "contents"),
    ("colima", "large", "Colima & Lima VMs", ("~/.colima", "~/.lima"), "info", "Reclaim with: colima delete, or docker system prune", "contents"),
    ("trash", "trash", "Trash", ("~/.Trash",), "review", "Items you already threw away. Emptying it is permanent", "contents"),
)
LOCATION_SCHEMA = "ord int, id string, category string, title string, paths array<string>, safety string, note string, mode string"

#: Desktop apps that keep caches beside their settings: folder and name, and the caches' names.
APPS = (
    ("Claude", "Claude"), ("Code", "VS Code"), ("Cursor", "Cursor"), ("Figma", "Figma"), ("Google/Chrome/Default", "Chrome profile"), ("Microsoft Teams", "Microsoft Teams"),
    ("Notion", "Notion"), ("Postman", "Postman"), ("Slack", "Slack"), ("Windsurf", "Windsurf"), ("discord", "Discord"), ("obsidian", "Obsidian"),
)
APP_FOLDERS = ("Cache", "Code Cache", "GPUCache", "CachedData", "CachedExtensionVSIXs", "Service Worker/CacheStorage", "logs")

_WEIGHTS = "Downloaded model weights"
#: Names of cache folders: title, and safety and note where they differ from the location's.
LABELS = (
    ("Homebrew", "Homebrew downloads", "safe", "Gentler: brew cleanup -s"), ("pip", "pip cache", "safe", None), ("Yarn", "Yarn cache", "safe", None), ("pnpm", "pnpm cache", "safe", None),
    ("CocoaPods", "CocoaPods cache", "safe", None), ("go-build", "Go build cache", "safe", None), ("org.swift.swiftpm", "SwiftPM cache", "safe", None), ("com.apple.dt.Xcode", "Xcode cache", "safe", None),
    ("ms-playwright", "Playwright browsers", "safe", "Restore: npx playwright install"), ("Cypress", "Cypress binaries", "safe", "Restore: npx cypress install"), ("puppeteer", "Puppeteer browsers", "safe", None),
    ("Google", "Google Chrome cache", "safe", None), ("Firefox", "Firefox cache", "safe", None), ("BraveSoftware", "Brave cache", "safe", None), ("com.spotify.client", "Spotify cache", "safe", None),
    ("JetBrains", "JetBrains IDE caches", "review", "Includes the IDEs' Local History"), ("rclone", "rclone cache", "review", "May hold files that were not uploaded yet"), ("pypoetry", "Poetry cache", "safe", None),
    ("uv", "uv cache", "safe", None), ("deno", "Deno cache", "safe", None), ("node-gyp", "node-gyp headers", "safe", None), ("electron", "Electron downloads", "safe", None),
    ("typescript", "TypeScript type cache", "safe", None), ("pre-commit", "pre-commit environments", "safe", None), ("bazel", "Bazel cache", "safe", None), ("ccache", "ccache", "safe", None), ("sccache", "sccache", "safe", None),
    ("huggingface", "Hugging Face models", "review", "Downloaded models and datasets"), ("torch", "PyTorch hub models", "review", _WEIGHTS), ("whisper", "Whisper models", "review", _WEIGHTS), ("lm-studio", "LM Studio models", "review", _WEIGHTS),
)
LABEL_SCHEMA = "name string, label string, label_safety string, label_note string"


def locations(home: str) -> list[tuple]:
    """Rows of LOCATION_SCHEMA with home filled in: the table above, then the caches of the desktop apps."""
    at = lambda p: home + p[1:] if p.startswith("~") else p
    rows = [(i, c, t, [at(p) for p in ps], s, n, m) for i, c, t, ps, s, n, m in LOCATIONS]
    rows += [("app-cache", "system", f"Cache · {name}", [f"{home}/Library/Application Support/{folder}/{x}" for x in APP_FOLDERS], "safe", "Rebuilt by the app; quit it first for a clean result", "contents") for folder, name in APPS]
    return [(i, *r) for i, r in enumerate(rows)]
