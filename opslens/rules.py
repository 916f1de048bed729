"""Rule tables of the source scan.

Fixed values: the patterns, labels and texts below define what the scan reports
and must equal the established rules.  They are plain data; callers may extend
or replace any table.
"""

from __future__ import annotations

RED_FLAGS = [
    ("raw new", r"\bnew\s+[A-Za-z_]"),
    ("malloc/free family", r"\b(?:malloc|calloc|realloc|free)\s*\("),
    ("C string funcs", r"\b(?:sprintf|strcpy|strcat|strncpy|gets|atoi|atol|alloca)\s*\("),
    ("catch-all (...)", r"\bcatch\s*\(\s*\.\.\.\s*\)"),
    ("const_cast", r"\bconst_cast\s*<"),
    ("reinterpret_cast", r"\breinterpret_cast\s*<"),
    ("dynamic_cast", r"\bdynamic_cast\s*<"),
    ("volatile", r"\bvolatile\b"),
    ("mutex-like types", r"\b(?:std::(?:recursive_)?mutex|pthread_mutex_t|CRITICAL_SECTION|QMutex)\b"),
    ("sleep calls", r"\b(?:sleep_for|sleep_until)\s*\(|\b::sleep\s*\(|\bSleep\s*\("),
    ("auto_ptr (deprecated)", r"\bauto_ptr\b"),
    ("goto", r"\bgoto\s+\w+"),
    ("void* usage", r"\bvoid\s*\*"),
    ("C-style cast", r"\(\s*(?:const\s+)?(?:unsigned\s+|signed\s+)?[A-Za-z_]\w*\s*\*+\s*\)\s*[A-Za-z_]"),
    ("typedef struct/union", r"\btypedef\s+(?:struct|union)\b"),
    ("typedef (prefer using)", r"\btypedef\b"),
    ("unscoped enum", r"\benum\s+[A-Za-z_]\w*\s*[{:]"),
    ("memset/ZeroMemory", r"\b(?:memset|ZeroMemory)\s*\("),
    ("printf family", r"\b(?:printf|fprintf|snprintf|puts|scanf)\s*\("),
    ("NULL macro", r"\bNULL\b"),
    ("exit() call", r"\b(?:exit|_exit)\s*\("),
    ("setjmp/longjmp", r"\b(?:setjmp|longjmp)\s*\("),
    ("this-> assignment", r"this->\s*[A-Za-z_]\w*\s*=[^=]"),
    ("default lambda capture", r"\[\s*(?:=|&)\s*\]|\[\s*=\s*,|\[\s*&\s*,"),
    (
        "catch by value",
        r"catch\s*\(\s*(?:const\s+)?(?:[A-Z][\w:]*|[\w:]+::[\w:]+)(?:\s*<[^<>]*>)?(?:\s+const)?\s+(?!&)[A-Za-z_]\w*\s*\)",
    ),
    ("signed/unsigned size() loop", r"\bfor\s*\(\s*(?:int|long|short)\s+\w+\s*=\s*0\s*;[^;\n]*\.size\s*\("),
    ("std::bind (prefer lambda)", r"\bstd::bind\s*\("),
    ("virtual + override together", r"\bvirtual\b[^;\n{}]*\boverride\b"),
    (
        "virtual without override",
        r"\bvirtual\b(?![^;\n]*\boverride\b)(?![^;\n]*=\s*0)(?![^;\n]*\bfinal\b)(?![^;\n]*~)",
    ),
]
HEADER_ONLY_FLAGS = [("using namespace (in header)", r"^\s*using\s+namespace\s+\w+")]
PRINTF_FLAG = "printf: size_t arg w/o %z (verify -Wformat)"
REACH_OUT_FLAG = "../ includes from header"

MEMBER_RULES = [
    ("_member (leading _)", r"\b_[a-z]\w*\b"),
    ("member_ (trailing _)", r"\b[a-z]\w*_\b"),
    ("m_member (m_ prefix)", r"\bm_[A-Za-z]\w*\b"),
]

TODO = r"\b(?:TODO|FIXME|HACK)\b"
INCLUDE = r"^\s*#\s*include\b"
INCLUDE_PATH = r'^\s*#\s*include\s*([<"])([^>"]+)[>"]'
GUARD = r"(?m)^\s*#\s*ifndef\s+\w+"
CONTROL_WORDS = ["if", "for", "while", "switch", "catch", "return", "else", "do"]

QUOTED = r'"([^"]*)"'
LOG_KEY = r"(?<![A-Za-z0-9_%])([A-Za-z_][A-Za-z0-9_]+)\s*(?:=|:(?!//))"
PRINTF_CALL = r"\b(?:std::)?(?:v?sn?printf|fprintf|printf)\s*\("
SIZE_ARGUMENT = r"\bsizeof\s*\(|\.size\s*\(\s*\)|\.length\s*\(\s*\)"
INT_CONVERSION = r"%(?:[-+ #0']*[\d*]*(?:\.\d+)?(?:hh|h|ll|l|L|j|t)?)(z?)([diouxX])"

CLASS_SAME_LINE = r"^(?:template\s*<[^<>]*>\s*)?(?:class|struct)\s+([A-Z_]\w*)[^;{}]*\{"
CLASS_NEXT_LINE = r"^(?:template\s*<[^<>]*>\s*)?(?:class|struct)\s+([A-Z_]\w*)[^;{}]*$"

WRAPPED = [
    ("time", "time()/std::time", r"(?<!::)\btime\s*\(\s*(?:NULL|nullptr|0)\s*\)|\bstd::time\s*\("),
    ("time", "chrono::system_clock", r"\bchrono::system_clock\b"),
    ("time", "chrono::steady_clock", r"\bchrono::steady_clock\b"),
    ("time", "gettimeofday*", r"gettimeofday"),
    ("time", "clock_gettime", r"\bclock_gettime\b"),
    ("time", "GetTickCount*", r"\bGetTickCount(?:64)?\b"),
    ("time", "GetSystemTime/LocalTime", r"\bGet(?:System|Local)Time\b"),
    ("time", "QueryPerformanceCounter", r"\bQueryPerformanceCounter\b"),
    ("time", "timeGetTime", r"\btimeGetTime\b"),
    ("time", "clock()", r"\bclock\s*\(\s*\)"),
    ("time", "spdk_get_ticks", r"\bspdk_get_ticks\b"),
    ("time", "boost::chrono", r"boost::chrono\b"),
    ("rand", "rand()/srand()", r"\b(?:srand|rand)\s*\("),
    ("rand", "rand_r", r"\brand_r\s*\("),
    ("rand", "std::mt19937 family", r"\bstd::(?:mt19937(?:_64)?|default_random_engine)\b"),
    ("rand", "std::random_device", r"\bstd::random_device\b"),
]
CRC_CALL = r"\b([A-Za-z_]\w*[Cc][Rr][Cc]\w*)\s*\("

MAGIC_NUMBER = r"(?<![\w.\"'])(?<!0[xX])[0-9]{2,}(?![\w.])"
CONSTANT_LINE = r"^\s*(?:#\s*define\b|enum\b|(?:(?:inline|static|extern)\s+)*(?:constexpr\b|const\b))"

BUILD_FLAGS = [
    ("warnings", "-Wall", r"-Wall\b"),
    ("warnings", "-Wextra", r"-Wextra\b"),
    ("warnings", "-Wpedantic/-pedantic", r"-Wpedantic\b|-pedantic\b"),
    ("warnings", "MSVC /W4 /Wall", r"(?i)/(?:W4|Wall)\b"),
    ("warnings", "MSVC /W3 (weak)", r"(?i)/W3\b"),
    ("warnings-as-errors", "-Werror (all)", r"-Werror(?![\w-]*=)"),
    ("warnings-as-errors", "-Werror=specific", r"-Werror="),
    ("warnings-as-errors", "MSVC /WX", r"(?i)/WX\b"),
    ("strict", "-Wconversion", r"-Wconversion\b"),
    ("strict", "-Wshadow", r"-Wshadow\b"),
    ("strict", "MSVC /permissive-", r"(?i)/permissive-"),
    ("hardening", "-fstack-protector*", r"-fstack-protector"),
    ("hardening", "-fstack-clash-protection", r"-fstack-clash-protection\b"),
    ("hardening", "-fcf-protection", r"-fcf-protection\b"),
    ("hardening", "-D_FORTIFY_SOURCE", r"(?:-D)?_FORTIFY_SOURCE"),
    ("hardening", "-D_GLIBCXX_ASSERTIONS", r"(?:-D)?_GLIBCXX_ASSERTIONS"),
    ("hardening", "MSVC /sdl", r"(?i)/sdl\b"),
    ("hardening", "MSVC /guard:cf", r"(?i)/guard:cf\b"),
    ("sanitizers", "-fsanitize=", r"-fsanitize(?:-recover)?="),
    ("sanitizers", "MSVC /fsanitize", r"(?i)/fsanitize\b"),
    ("global-state (§7 anti-pattern)", "add_compile_options/add_definitions", r"\badd_compile_options\s*\(|\badd_definitions\s*\("),
    ("global-state (§7 anti-pattern)", "set(CMAKE_CXX_FLAGS ...)", r"set\s*\(\s*CMAKE_CXX_FLAGS"),
    ("standards", "CMAKE_CXX_EXTENSIONS OFF", r"CMAKE_CXX_EXTENSIONS\s+OFF"),
]
SUGGESTIONS = {
    "warnings": "-Wall -Wextra (-Wpedantic) or MSVC /W4",
    "warnings-as-errors": "-Werror / MSVC /WX (at least first-party targets & CI)",
    "hardening": "-fstack-protector-strong, -D_GLIBCXX_ASSERTIONS, /sdl, /guard:cf",
    "sanitizers": "-fsanitize=address,undefined in dev/CI builds",
}
RUNTIME_COST = {
    "warnings": "compile-time only, no runtime cost",
    "warnings-as-errors": "compile-time only, no runtime cost",
    "strict": "compile-time only, no runtime cost",
    "hardening": "runtime ~0-3%, usually negligible (inform user; keep/remove is their call)",
    "sanitizers": "runtime HIGH: ASan ~2x CPU / 2-3x memory, dev/CI only — inform user; "
    "removal decision is theirs, never propose removing as a fix",
    "global-state (§7 anti-pattern)": "compile-time only, no runtime cost",
    "standards": "compile-time only, no runtime cost",
}
