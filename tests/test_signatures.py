"""The rules of SURVEY 2.11 that the first built-in set lacked."""

from pyspark.sql import functions as F

from quern.functions import signatures

NEAR = {  # one text that matches, one that just doesn't
    "file_encryptor": ("aes.new walk( open(", "aes.new walk("), "process_injection": ("NtCreateThreadEx kernel32", "NtCreateThreadEx"), "anti_debugging": ("qemu check", "qemu"), "sandbox_evasion": ("sleep(" * 6, "sleep(" * 5),
    "persistence_registry": (r"HKCU\Software\Microsoft\Windows\CurrentVersion\Run winreg", r"HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run winreg"), "data_exfiltration": ("requests.post json.dumps read(", "requests.post json.dumps"),
    "suspicious_powershell": ("pwsh iwr", "pwsh"), "malicious_python_script": ("import os os.system eval( socket bypass", "IMPORT OS os.system eval( socket bypass"), "java_reflection_abuse": ("Class.forName invoke( Runtime", "Class.forName Runtime"),
    "java_unsafe_operations": ("sun.misc.Unsafe putAddress", "allocateMemory putAddress"), "powershell_download_execute": ("Net.WebClient iex", "Net.WebClient"), "powershell_encoded_command": ("-Enc", "enc"), "ruby_command_execution": ("system( bash -c", "system( bash"),
    "go_command_execution": ("os/exec exec.Command", "os/exec"), "rust_unsafe_operations": ("unsafe { libc::system", "unsafe {"),
}


def test_all_of_the_survey(spark):
    rules = signatures.load()
    by = [sum(r["severity"] == s for r in rules) for s in ("critical", "high", "medium")]
    assert len(rules) == 34 and by == [11, 17, 6] and sum(len(r["strings"]) for r in rules) == 255
    df = spark.createDataFrame([(i, t) for i, t in enumerate(t for pair in NEAR.values() for t in pair)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(signatures.matched("x", rules)).collect()]
    for k, name in enumerate(NEAR):
        assert name in got[2 * k] and name not in got[2 * k + 1], name
    assert [tuple(r) for r in spark.createDataFrame([(["go_command_execution"],)], "x array<string>").select(signatures.severity_score(F.col("x")), signatures.top_severity(F.col("x"))).collect()] == [(75, "HIGH")]
