"""Rules as data. All values here are fixed values, needed for equal results."""

from __future__ import annotations

#: severity -> value
SEVERITY = {"CRITICAL": 10.0, "HIGH": 7.5, "MEDIUM": 5.0, "LOW": 2.5, "INFO": 1.0}

# Weighted keywords, in order: keyword | weight | severity | multipliers (fn cls var cmt str imp path) | requires any | excludes any
_KEYWORDS = """
ransomware|10|CRITICAL|fn=2 cls=2 path=1.5 cmt=0.5||
keylogger|10|CRITICAL|fn=2 cls=2 var=1.5 cmt=0.3||
backdoor|9|CRITICAL|fn=2 cls=1.8 cmt=0.4||
rootkit|10|CRITICAL|fn=2 cls=2 path=1.5||
cryptominer|9|CRITICAL|fn=1.8 cls=1.8 cmt=0.5||
exploit|8|HIGH|fn=1.8 cls=1.5 cmt=0.6||test,demo,example,tutorial
payload|7.5|HIGH|fn=1.8 var=1.5 cmt=0.7|execute,inject,deliver,send|
shellcode|9|HIGH|fn=2 var=1.8 str=1.5||
reverse_shell|9|HIGH|fn=2 cls=1.8 cmt=0.5||
privilege_escalation|8.5|HIGH|fn=1.8 cmt=0.7||
code_injection|8|HIGH|fn=1.8 cls=1.5||
stealer|9|HIGH|fn=2 cls=2 path=1.5|password,credential,token,cookie,data|
exfiltrate|8.5|HIGH|fn=1.8 var=1.5|data,file,credential,send|
obfuscate|6|MEDIUM|fn=1.5 cmt=0.8||deobfuscate,analysis,research
encrypt|2|LOW|fn=1 cmt=0.3|malicious,bypass,hide,stealth,ransom|
bypass|6.5|MEDIUM|fn=1.5 cmt=0.7|antivirus,firewall,security,detection|
persistence|6|MEDIUM|fn=1.5 cmt=0.8|registry,autostart,scheduled,service|
hook|5.5|MEDIUM|fn=1.4 cmt=0.6|keyboard,mouse,window,api|
download|2|LOW|fn=1 cmt=0.5|execute,run,payload,malicious|
execute|2.5|LOW|fn=1.2 cmt=0.5|remote,arbitrary,shellcode,payload|
password|2|LOW|fn=1 cmt=0.3|steal,dump,crack,harvest,grab|
Runtime.getRuntime().exec|8|HIGH|str=1.8 fn=1.5||
ProcessBuilder|7|HIGH|cls=1.8 var=1.5||
sun.misc.Unsafe|7.5|HIGH|imp=2 str=1.5||
ClassLoader.defineClass|8|HIGH|str=1.8||
invokespecial|6|MEDIUM|str=1.5||
system(|7.5|HIGH|str=1.8||
execve|8.5|HIGH|str=2 fn=1.8||
CreateRemoteThread|9|CRITICAL|str=2 fn=2||
VirtualAllocEx|8.5|HIGH|str=2 fn=1.8||
WriteProcessMemory|8.5|HIGH|str=2 fn=1.8||
ptrace|7.5|HIGH|str=1.8 fn=1.5||
LD_PRELOAD|8|HIGH|str=2 var=1.8||
gets(|6|MEDIUM|str=1.5||
strcpy(|5|MEDIUM|str=1.3||strncpy,strcpy_s
eval(|8|HIGH|str=1.8 fn=1.5||
base64_decode|6|MEDIUM|str=1.5|eval,exec,system|
shell_exec|8|HIGH|str=1.8 fn=1.5||
passthru|7.5|HIGH|str=1.8||
assert(|7|HIGH|str=1.5||
create_function|7.5|HIGH|str=1.8||
preg_replace|6|MEDIUM|str=1.5|/e,eval|
Kernel.eval|8|HIGH|str=1.8||
instance_eval|7|HIGH|str=1.5||
IO.popen|7.5|HIGH|str=1.8||
send(|5|MEDIUM|str=1.3|method,call|
os/exec.Command|7.5|HIGH|str=1.8 imp=1.5||
syscall.Exec|8|HIGH|str=1.8||
unsafe.Pointer|7|MEDIUM|str=1.5 var=1.3||
reflect.Call|6|MEDIUM|str=1.5||
std::process::Command|7.5|HIGH|str=1.8 imp=1.5||
unsafe {|6|MEDIUM|str=1.5||
libc::system|8|HIGH|str=1.8||
std::mem::transmute|7|MEDIUM|str=1.5||
Invoke-Expression|8|HIGH|str=1.8 fn=1.5||
IEX|8|HIGH|str=1.8||
Invoke-WebRequest|6|MEDIUM|str=1.5|IEX,Invoke-Expression,downloadstring|
Start-Process|6.5|MEDIUM|str=1.5||
-EncodedCommand|7.5|HIGH|str=1.5||
DownloadString|7|HIGH|str=1.5|IEX,Invoke|
UNION SELECT|7.5|HIGH|str=1.8 cmt=0.5||
' OR '1'='1|8|HIGH|str=2||
xp_cmdshell|9|CRITICAL|str=1.8||
"""


def keywords() -> list[dict]:
    """ord, keyword, base (weight x severity), severity, multipliers, requires, excludes."""
    out = []
    for ord_, row in enumerate(_KEYWORDS.strip().split("\n")):
        keyword, weight, severity, contexts, requires, excludes = row.split("|")
        times = {k: float(v) for k, v in (c.split("=") for c in contexts.split())}
        out.append({"ord": ord_, "keyword": keyword, "severity": severity, "base": float(weight) * SEVERITY[severity], "fn": times.get("fn", 1.0), "cls": times.get("cls", 1.0), "var": times.get("var", 1.0), "cmt": times.get("cmt", 1.0), "imp": times.get("imp", 1.0), "requires": [x for x in requires.split(",") if x], "excludes": [x for x in excludes.split(",") if x]})
    return out


# Keyword rules: rule | severity | all of | how many of | of these | any of | base score
_RULES = """
credential_stealer|CRITICAL|password,steal|||browser,chrome,firefox,credential,token|8
reverse_shell_connection|CRITICAL||2|socket,connect,shell,cmd,bash,powershell||9
ransomware_behavior|CRITICAL||3|encrypt,decrypt,payment,bitcoin,ransom,victim||10
keylogger_detection|CRITICAL|keyboard,hook|||log,capture,record,monitor|9
process_injection|HIGH||2|inject,process,memory,write,allocate||8
persistence_mechanism|HIGH||2|registry,autostart,scheduled_task,service,startup|persist,maintain,install|7
c2_communication|HIGH||2|connect,send,receive,command,control|beacon,callback,heartbeat,exfiltrate|8
anti_analysis|HIGH||2|debugger,virtual,sandbox,detect,check|bypass,evade,anti|7.5
network_scanner|MEDIUM|scan,port|||network,host,ip,target|5
crypto_mining|HIGH||2|mining,miner,hashrate,pool,stratum|monero,bitcoin,ethereum,crypto|8
remote_access_trojan|CRITICAL||3|remote,control,screen,keyboard,mouse,file,command||9
data_exfiltration|HIGH|send,data|||exfiltrate,upload,transfer,steal|8
"""


def rules() -> list[dict]:
    """rule, all_of, n, n_of, any_of, score (base x severity x number of groups)."""
    out = []
    for row in _RULES.strip().split("\n"):
        rule, severity, all_of, n, n_of, any_of, base = row.split("|")
        groups = [[x for x in g.split(",") if x] for g in (all_of, n_of, any_of)]
        out.append({"rule": rule, "all_of": groups[0], "n": int(n or 0), "n_of": groups[1], "any_of": groups[2], "score": float(base) * SEVERITY[severity] * sum(map(bool, groups))})
    return out


# Pairs of keywords and their boost
PAIRS = [
    ("socket", "execute", 3.0), ("download", "execute", 3.5), ("encrypt", "ransom", 5.0), ("encrypt", "bitcoin", 4.5), ("password", "steal", 4.0), ("password", "dump", 3.5), ("keylog", "send", 4.0),
    ("screenshot", "send", 3.0), ("credential", "exfiltrate", 4.5), ("privilege", "escalate", 3.5), ("bypass", "antivirus", 4.0), ("bypass", "firewall", 3.5), ("inject", "process", 4.0), ("inject", "code", 3.5),
    ("hook", "keyboard", 3.5), ("backdoor", "persist", 4.0), ("reverse", "shell", 4.5), ("command", "control", 3.0), ("obfuscate", "malicious", 3.5), ("exploit", "vulnerability", 3.0), ("rootkit", "hide", 4.0),
    ("trojan", "payload", 3.5), ("virus", "spread", 3.0), ("botnet", "zombie", 3.5), ("mine", "crypto", 3.0), ("scan", "exploit", 2.5), ("brute", "force", 2.5),
]

# Sets of keywords over several files and their multiplier
CROSS_FILE = [
    (["encrypt", "decrypt", "payment"], 2.5), (["keylog", "send", "server"], 2.8), (["download", "execute", "payload"], 2.3), (["steal", "password", "browser"], 2.5),
    (["inject", "process", "memory"], 2.4), (["bypass", "antivirus", "disable"], 2.6), (["backdoor", "persist", "hide"], 2.7), (["scan", "exploit", "target"], 2.2),
]

#: Words that never count as tokens
STOP_WORDS = "for while if else elif def class return import from as try except finally with int str bool float list dict set tuple true false none null void public private protected static const var let function".split()

#: Suspicious expressions, matched without regard to case
PATTERNS = [
    r"eval\s*\(", r"exec\s*\(", r"__import__\s*\(", r"compile\s*\(", r"system\s*\(", r"popen\s*\(", r"subprocess\.", r"os\.system", r"memcpy\s*\(", r"strcpy\s*\(", r"gets\s*\(", r"scanf\s*\(", r"CreateRemoteThread",
    r"VirtualAlloc", r"WriteProcessMemory", r"OpenProcess", r"SetWindowsHook", r"ptrace\s*\(", r"Runtime\.getRuntime\(\)\.exec", r"ProcessBuilder", r"ClassLoader\.defineClass", r"sun\.misc\.Unsafe", r"shell_exec\s*\(",
    r"passthru\s*\(", r"base64_decode\s*\(", r"assert\s*\(", r"create_function\s*\(", r"preg_replace.*\/e", r"Invoke-Expression", r"\bIEX\b", r"-EncodedCommand", r"DownloadString", r"Start-Process", r"Kernel\.eval",
    r"instance_eval", r"IO\.popen", r"os/exec\.Command", r"syscall\.Exec", r"UNION\s+SELECT", r"'\s*OR\s*'1'\s*=\s*'1", r"xp_cmdshell", r"socket\s*\(", r"bind\s*\(", r"listen\s*\(", r"connect\s*\(",
]

SUSPICIOUS_FILE_PATTERNS = "exploit payload backdoor shell reverse keylog inject bypass crack hack malware trojan virus".split()
EXECUTABLE = ".py .js .jsx .ts .tsx .sh .bash .zsh .fish .ps1 .bat .cmd .vbs .exe .dll .so .dylib .bin .elf .java .class .jar .war .ear .c .cpp .cc .cxx .h .hpp .hxx .php .php3 .php4 .php5 .phtml .rb .rbw .go .rs .html .htm .asp .aspx .jsp .xml .json .yaml .yml .conf .config .sql .pl .cgi .lua .tcl".split()
CODE = ".py .js .java .c .cpp .h .hpp .cs .php .rb .go .rs .swift .kt .scala .sh .bash .ps1 .bat .cmd .vbs .pl .lua .r .m .asm".split()
SUSPICIOUS_EXTENSIONS = ".exe .dll .so .dylib .bat .ps1 .vbs .sh .scr".split()
SUSPICIOUS_NAMES = "payload exploit backdoor trojan virus malware hack crack keygen loader injector stealer".split()
TEXT = ".py .js .ts .java .cpp .c .h .hpp .cs .go .rs .php .rb .swift .kt .scala .clj .hs .ml .r .m .sh .bash .zsh .ps1 .sql .html .css .xml .json .yaml .yml .toml .ini .cfg .conf .md .txt .rst .tex .dockerfile .makefile .cmake .rtf .log .gitignore .license .copying".split() + [""]
BINARY = ".exe .bin .dll .so .dylib .jar .class .pyc .zip .tar .gz .7z .rar .pdf .doc .docx .jpg .jpeg .png .gif .bmp .ico .svg".split()
WORKING_TREE = ".py .js .ts .java .cpp .c .h .hpp .cs .go .rs .php .rb .swift .kt .scala .clj .hs .ml .r .m .sh .bash .zsh .ps1 .sql .html .css .xml .json .yaml .yml .toml .ini .cfg .conf .md .txt .rst .tex .dockerfile .makefile .cmake".split()

#: Languages of the extension vote, in order
LANGUAGE_EXTENSIONS = {
    "Python": [".py"], "JavaScript": [".js", ".jsx", ".mjs"], "TypeScript": [".ts", ".tsx"], "Go": [".go"], "Java": [".java"], "C": [".c", ".h"], "C++": [".cc", ".cpp", ".cxx", ".hpp", ".hxx"], "Ruby": [".rb"],
    "PHP": [".php"], "Rust": [".rs"], "C#": [".cs"], "Swift": [".swift"], "Kotlin": [".kt"], "Scala": [".scala"],
}
SUPPORTED_LANGUAGES = "Python JavaScript Go TypeScript Java C C++ Ruby PHP Rust C# Swift Kotlin Scala".split()
CRAWL_LANGUAGES = "Python JavaScript Go TypeScript Java C C++ Ruby PHP Rust".split()

#: Root files and suffixes that vote for a language, in order: 10 for a file in the root, 1 for each file with the suffix
INDICATORS = {
    "go": ["go.mod", "go.sum", "*.go"], "python": ["setup.py", "requirements.txt", "pyproject.toml", "*.py"], "javascript": ["package.json", "package-lock.json", "*.js", "*.jsx"],
    "typescript": ["package.json", "tsconfig.json", "*.ts", "*.tsx"], "java": ["pom.xml", "build.gradle", "*.java"], "c": ["Makefile", "CMakeLists.txt", "*.c", "*.h"], "cpp": ["Makefile", "CMakeLists.txt", "*.cpp", "*.hpp"],
    "ruby": ["Gemfile", "*.rb"], "php": ["composer.json", "*.php"], "rust": ["Cargo.toml", "*.rs"],
}

#: Built-in signatures; more are read from rule files given as a parameter (quern.functions.signatures.load).
SIGNATURES = r"""
rule credential_stealer { meta: description = "Detects credential stealing patterns" severity = "critical" category = "credential_theft" strings: $pass1 = "password" nocase $pass2 = "passwd" nocase $pass3 = "credential" nocase $steal1 = "steal" nocase $steal2 = "harvest" nocase $steal3 = "extract" nocase $browser1 = "chrome" nocase $browser2 = "firefox" nocase $browser3 = "browser" nocase condition: ($pass1 or $pass2 or $pass3) and ($steal1 or $steal2 or $steal3) and ($browser1 or $browser2 or $browser3) }
rule password_dumper { meta: description = "Detects password dumping utilities" severity = "critical" category = "credential_theft" strings: $dump1 = "mimikatz" nocase $dump2 = "lsass" nocase $dump3 = "sam.sav" nocase $dump4 = "procdump" nocase $dump5 = "secretsdump" nocase $action1 = "dump" nocase $action2 = "extract" nocase condition: any of ($dump*) or (any of ($action*) and #action1 > 2) }
rule reverse_shell { meta: description = "Detects reverse shell patterns" severity = "critical" category = "backdoor" strings: $socket1 = "socket.socket" nocase $socket2 = "socket.connect" nocase $socket3 = "Socket" nocase $shell1 = "/bin/sh" nocase $shell2 = "/bin/bash" nocase $shell3 = "cmd.exe" nocase $shell4 = "powershell" nocase $exec1 = "subprocess.Popen" nocase $exec2 = "os.system" nocase $exec3 = "exec(" nocase $exec4 = "eval(" nocase condition: (any of ($socket*)) and (any of ($shell*) or any of ($exec*)) }
rule bind_shell { meta: description = "Detects bind shell patterns" severity = "critical" category = "backdoor" strings: $bind1 = "socket.bind" nocase $bind2 = "socket.listen" nocase $bind3 = "socket.accept" nocase $shell1 = "/bin/sh" $shell2 = "cmd.exe" $shell3 = "powershell" condition: 2 of ($bind*) and any of ($shell*) }
rule webshell { meta: description = "Detects web shell patterns" severity = "critical" category = "backdoor" strings: $php1 = "<?php" $php2 = "eval($_" $php3 = "system($_" $php4 = "exec($_" $php5 = "passthru($_" $php6 = "shell_exec($_" $asp1 = "execute request" $asp2 = "eval request" $generic1 = "cmd" nocase $generic2 = "command" nocase condition: ($php1 and any of ($php2,$php3,$php4,$php5,$php6)) or any of ($asp*) or (any of ($generic*) and any of ($php*)) }
rule ransomware_behavior { meta: description = "Detects ransomware-like behavior" severity = "critical" category = "ransomware" strings: $encrypt1 = "encrypt" nocase $encrypt2 = "cipher" nocase $encrypt3 = "aes" nocase $encrypt4 = "rsa" nocase $ransom1 = "ransom" nocase $ransom2 = "payment" nocase $ransom3 = "bitcoin" nocase $ransom4 = "decrypt" nocase $ransom5 = "victim" nocase $file1 = "walkdir" nocase $file2 = "listdir" nocase $file3 = "glob" nocase condition: (any of ($encrypt*)) and (2 of ($ransom*)) and (any of ($file*)) }
rule file_encryptor { meta: description = "Detects file encryption functionality" severity = "high" category = "ransomware" strings: $crypto1 = "Crypto.Cipher" nocase $crypto2 = "cryptography" nocase $crypto3 = "AES.new" nocase $crypto4 = "Cipher.new" nocase $loop1 = "for file in" nocase $loop2 = "walk(" nocase $loop3 = "glob(" nocase $write1 = ".write(" nocase $write2 = "open(" nocase condition: any of ($crypto*) and any of ($loop*) and any of ($write*) }
rule keylogger { meta: description = "Detects keystroke logging" severity = "critical" category = "spyware" strings: $hook1 = "SetWindowsHookEx" nocase $hook2 = "GetAsyncKeyState" nocase $hook3 = "keyboard.hook" nocase $hook4 = "pynput" nocase $key1 = "keyboard" nocase $key2 = "keystroke" nocase $key3 = "keypress" nocase $log1 = "log" nocase $log2 = "record" nocase $log3 = "capture" nocase condition: (any of ($hook*)) or ((any of ($key*)) and (any of ($log*)) and #log1 > 2) }
rule process_injection { meta: description = "Detects process injection techniques" severity = "high" category = "execution" strings: $inject1 = "VirtualAllocEx" nocase $inject2 = "WriteProcessMemory" nocase $inject3 = "CreateRemoteThread" nocase $inject4 = "NtCreateThreadEx" nocase $python1 = "ctypes.windll" nocase $python2 = "kernel32" nocase condition: 2 of ($inject*) or (any of ($inject*) and any of ($python*)) }
rule anti_debugging { meta: description = "Detects anti-debugging techniques" severity = "high" category = "evasion" strings: $debug1 = "IsDebuggerPresent" nocase $debug2 = "CheckRemoteDebuggerPresent" nocase $debug3 = "NtQueryInformationProcess" nocase $debug4 = "debugger" nocase $vm1 = "VMware" nocase $vm2 = "VirtualBox" nocase $vm3 = "QEMU" nocase $vm4 = "virtual machine" nocase $detect1 = "detect" nocase $detect2 = "check" nocase condition: (any of ($debug*)) or ((any of ($vm*)) and (any of ($detect*))) }
rule sandbox_evasion { meta: description = "Detects sandbox evasion techniques" severity = "high" category = "evasion" strings: $sleep1 = "sleep(" nocase $sleep2 = "time.sleep" nocase $sleep3 = "Sleep(" nocase $check1 = "GetTickCount" nocase $check2 = "QueryPerformanceCounter" nocase $user1 = "GetUserName" nocase $user2 = "GetComputerName" nocase condition: (any of ($sleep*) and #sleep1 > 5) or (any of ($check*)) or (2 of ($user*)) }
rule persistence_registry { meta: description = "Detects registry persistence mechanisms" severity = "high" category = "persistence" strings: $reg1 = "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run" nocase $reg2 = "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunOnce" nocase $reg3 = "HKEY_CURRENT_USER\\Software\\Microsoft\\Windows\\CurrentVersion\\Run" nocase $reg4 = "HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run" nocase $func1 = "RegSetValueEx" nocase $func2 = "winreg" nocase $func3 = "reg add" nocase condition: any of ($reg*) and any of ($func*) }
rule persistence_scheduled_task { meta: description = "Detects scheduled task persistence" severity = "high" category = "persistence" strings: $schtask1 = "schtasks" nocase $schtask2 = "ScheduledTask" nocase $schtask3 = "Register-ScheduledTask" nocase $cron1 = "crontab" nocase $cron2 = "/etc/cron" nocase condition: any of them }
rule c2_communication { meta: description = "Detects command and control patterns" severity = "high" category = "c2" strings: $http1 = "http://" nocase $http2 = "https://" nocase $cmd1 = "command" nocase $cmd2 = "control" nocase $cmd3 = "beacon" nocase $cmd4 = "callback" nocase $cmd5 = "heartbeat" nocase $data1 = "exfiltrate" nocase $data2 = "upload" nocase $data3 = "download" nocase $base641 = "base64" nocase condition: (any of ($http*)) and (any of ($cmd*)) and (any of ($data*) or $base641) }
rule data_exfiltration { meta: description = "Detects data exfiltration patterns" severity = "high" category = "exfiltration" strings: $net1 = "requests.post" nocase $net2 = "urllib.request" nocase $net3 = "http.client" nocase $net4 = "socket.send" nocase $data1 = "json.dumps" nocase $data2 = "pickle.dumps" nocase $data3 = "base64.b64encode" nocase $file1 = "open(" nocase $file2 = "read(" nocase condition: any of ($net*) and any of ($data*) and any of ($file*) }
rule crypto_miner { meta: description = "Detects cryptocurrency mining" severity = "high" category = "crypto_miner" strings: $coin1 = "monero" nocase $coin2 = "xmrig" nocase $coin3 = "stratum" nocase $coin4 = "pool.minexmr" nocase $coin5 = "cryptonight" nocase $mining1 = "mining" nocase $mining2 = "miner" nocase $mining3 = "hashrate" nocase condition: any of ($coin*) or (2 of ($mining*)) }
rule code_obfuscation { meta: description = "Detects code obfuscation techniques" severity = "medium" category = "obfuscation" strings: $obf1 = "eval(" nocase $obf2 = "exec(" nocase $obf3 = "compile(" nocase $enc1 = "base64.b64decode" nocase $enc2 = "decode('hex')" nocase $enc3 = "unhexlify" nocase $dyn1 = "getattr(" nocase $dyn2 = "__import__" nocase condition: (any of ($obf*) and #obf1 > 3) or (any of ($enc*) and any of ($obf*)) or (2 of ($dyn*)) }
rule network_scanner { meta: description = "Detects network scanning functionality" severity = "medium" category = "reconnaissance" strings: $scan1 = "port scan" nocase $scan2 = "nmap" nocase $scan3 = "masscan" nocase $socket1 = "socket.connect" nocase $loop1 = "for port in range" nocase $net1 = "192.168" nocase $net2 = "10.0" nocase condition: any of ($scan*) or ($socket1 and $loop1) or (any of ($net*) and $socket1) }
rule suspicious_powershell { meta: description = "Detects suspicious PowerShell patterns" severity = "high" category = "execution" strings: $ps1 = "powershell" nocase $ps2 = "pwsh" nocase $flag1 = "-EncodedCommand" nocase $flag2 = "-Enc" nocase $flag3 = "-ExecutionPolicy Bypass" nocase $flag4 = "-WindowStyle Hidden" nocase $flag5 = "-NoProfile" nocase $dl1 = "DownloadString" nocase $dl2 = "DownloadFile" nocase $dl3 = "Invoke-WebRequest" nocase $dl4 = "IWR" nocase $exec1 = "Invoke-Expression" nocase $exec2 = "IEX" nocase condition: (any of ($ps*)) and (any of ($flag*) or any of ($dl*) or any of ($exec*)) }
rule malicious_python_script { meta: description = "Detects potentially malicious Python patterns" severity = "medium" category = "malware" strings: $py1 = "#!/usr/bin/env python" $py2 = "import os" $py3 = "import sys" $danger1 = "os.system" nocase $danger2 = "subprocess.call" nocase $danger3 = "eval(" nocase $danger4 = "exec(" nocase $net1 = "socket" nocase $net2 = "urllib" nocase $net3 = "requests" nocase $stealth1 = "hidden" nocase $stealth2 = "bypass" nocase condition: (any of ($py*)) and (2 of ($danger*)) and (any of ($net*)) and (any of ($stealth*)) }
rule java_command_execution { meta: description = "Detects Java command execution patterns" severity = "high" category = "code_execution" strings: $exec1 = "Runtime.getRuntime().exec" nocase $exec2 = "ProcessBuilder" nocase $exec3 = ".start()" nocase $danger1 = "cmd" nocase $danger2 = "/bin/sh" nocase $danger3 = "powershell" nocase condition: (any of ($exec*)) and (any of ($danger*)) }
rule java_reflection_abuse { meta: description = "Detects Java reflection for malicious purposes" severity = "medium" category = "code_execution" strings: $reflect1 = "Class.forName" nocase $reflect2 = "getDeclaredMethod" nocase $reflect3 = "setAccessible(true)" nocase $reflect4 = "invoke(" nocase $danger1 = "Runtime" nocase $danger2 = "ProcessBuilder" nocase condition: (2 of ($reflect*)) and (any of ($danger*)) }
rule java_unsafe_operations { meta: description = "Detects Java Unsafe API usage" severity = "high" category = "memory_manipulation" strings: $unsafe1 = "sun.misc.Unsafe" nocase $unsafe2 = "allocateMemory" nocase $unsafe3 = "putAddress" nocase $unsafe4 = "defineClass" nocase condition: $unsafe1 and any of ($unsafe2,$unsafe3,$unsafe4) }
rule windows_process_injection { meta: description = "Detects Windows process injection techniques" severity = "critical" category = "process_injection" strings: $api1 = "CreateRemoteThread" nocase $api2 = "VirtualAllocEx" nocase $api3 = "WriteProcessMemory" nocase $api4 = "OpenProcess" nocase condition: 3 of them }
rule linux_process_injection { meta: description = "Detects Linux/Unix process injection" severity = "critical" category = "process_injection" strings: $ptrace1 = "ptrace" nocase $ptrace2 = "PTRACE_ATTACH" nocase $ptrace3 = "PTRACE_POKETEXT" nocase $preload1 = "LD_PRELOAD" nocase $preload2 = "LD_LIBRARY_PATH" nocase condition: (2 of ($ptrace*)) or (any of ($preload*)) }
rule unsafe_c_functions { meta: description = "Detects use of unsafe C functions" severity = "medium" category = "buffer_overflow" strings: $unsafe1 = "gets(" nocase $unsafe2 = "strcpy(" nocase $unsafe3 = "sprintf(" nocase $unsafe4 = "strcat(" nocase $exec1 = "system(" nocase $exec2 = "execve" nocase condition: (2 of ($unsafe*)) and (any of ($exec*)) }
rule php_webshell { meta: description = "Detects PHP webshell patterns" severity = "critical" category = "webshell" strings: $php = "<?php" $exec1 = "eval($_" nocase $exec2 = "system($_" nocase $exec3 = "exec($_" nocase $exec4 = "shell_exec($_" nocase $exec5 = "passthru($_" nocase $exec6 = "assert($_" nocase $decode = "base64_decode" nocase condition: $php and ((any of ($exec*)) or ($decode and any of ($exec*))) }
rule php_backdoor { meta: description = "Detects PHP backdoor patterns" severity = "critical" category = "backdoor" strings: $create1 = "create_function" nocase $create2 = "preg_replace" nocase $eval = "eval(" nocase $assert = "assert(" nocase $encode1 = "base64_decode" nocase $encode2 = "gzinflate" nocase $encode3 = "str_rot13" nocase condition: (any of ($create*)) and ($eval or $assert) and (any of ($encode*)) }
rule powershell_download_execute { meta: description = "Detects PowerShell download and execute pattern" severity = "high" category = "downloader" strings: $download1 = "Invoke-WebRequest" nocase $download2 = "DownloadString" nocase $download3 = "Net.WebClient" nocase $exec1 = "Invoke-Expression" nocase $exec2 = "IEX" nocase $exec3 = "Start-Process" nocase condition: (any of ($download*)) and (any of ($exec*)) }
rule powershell_encoded_command { meta: description = "Detects PowerShell encoded command execution" severity = "high" category = "obfuscation" strings: $encoded1 = "-EncodedCommand" nocase $encoded2 = "-enc" nocase $convert1 = "FromBase64String" nocase $convert2 = "Convert" nocase condition: any of ($encoded*) or (any of ($convert*)) }
rule ruby_command_execution { meta: description = "Detects Ruby command execution patterns" severity = "high" category = "code_execution" strings: $exec1 = "system(" nocase $exec2 = "exec(" nocase $exec3 = "IO.popen" nocase $exec4 = "Kernel.eval" nocase $shell1 = "sh -c" nocase $shell2 = "bash -c" nocase $shell3 = "cmd /c" nocase condition: (any of ($exec*)) and (any of ($shell*)) }
rule go_command_execution { meta: description = "Detects Go command execution patterns" severity = "high" category = "code_execution" strings: $import1 = "os/exec" nocase $import2 = "syscall" nocase $exec1 = "exec.Command" nocase $exec2 = "syscall.Exec" nocase $exec3 = "syscall.ForkExec" nocase condition: (any of ($import*)) and (any of ($exec*)) }
rule rust_unsafe_operations { meta: description = "Detects Rust unsafe operations" severity = "medium" category = "unsafe_code" strings: $unsafe1 = "unsafe {" nocase $unsafe2 = "std::ptr::" nocase $unsafe3 = "std::mem::transmute" nocase $libc1 = "libc::system" nocase $libc2 = "libc::execve" nocase condition: (any of ($unsafe*)) and (any of ($libc*)) }
rule sql_injection_attempts { meta: description = "Detects SQL injection patterns" severity = "high" category = "injection" strings: $sqli1 = "UNION SELECT" nocase $sqli2 = "' OR '1'='1" nocase $sqli3 = "' OR 1=1" nocase $sqli4 = "'; DROP TABLE" nocase $sqli5 = "xp_cmdshell" nocase condition: any of them }
"""
