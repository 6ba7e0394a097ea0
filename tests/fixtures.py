"""Texts that are appended to the files of a table, so that rules have something to match."""

from __future__ import annotations

#: The tables' own texts hold hardly any of the rules' words, so the tests append one of
#: these to every file, by its length.
SNIPPETS = [
    "def backdoor(x):\n    keylogger = x\n    return keylogger\n",
    "import subprocess\n# download the payload\ndownload(url)\nexecute(payload)\neval(x)\neval (x)\n",
    "class Stealer:\n    def run(self):\n        password = steal(browser)\n        token = credential\n        send(data)\n",
    "function inject(process) { memory.write(process); shell(cmd); }\nsocket.connect(host); exec(bash);\n",
    "encrypt(file); ransom = bitcoin; decrypt(victim); payment(glob);\n",
    "# connect and listen\nsocket(a); bind(b); listen(c); connect (d); os.system(e)\n",
    "def exploit_test():\n    exploit = demo\n    shellcode = base64_decode(x)\n    shell_exec(shellcode)\n",
    "SELECT a UNION SELECT b\nxp_cmdshell = 1\ncrontab = stratum\n",
    "int f() { char b[9]; gets(b); strcpy(b, x); sprintf(b, y); system(b); ptrace(0); LD_PRELOAD; }\n",
    "reverse_shell = 1\nbypass(firewall)\npersistence(registry)\nhook(keyboard)\ncapture = log\n",
    "Runtime.getRuntime().exec(cmd); new ProcessBuilder(x).start(); OpenProcess(a); CreateRemoteThread(b); WriteProcessMemory(c);\n",
    "const x = require('https://beacon.example/upload'); // rootkit exfiltrate\nmine(crypto); miner.pool(hashrate);\n",
    "nothing_here = 1\n",
]

#: Appended likewise, so that programs begin somewhere.
MAINS = ["if __name__ == '__main__':\n", "def main():\n", "func main() {}\n", "public static void main(String[] a) {}\n", "int main(void) {}\n", "export default x\n", "pass\n"]


def enriched(spark, given: str, folder: str) -> str:
    """A folder with the tables of ``given``, where every text of ``files`` ends with a snippet and a main."""
    import os

    from pyspark.sql import functions as F

    os.makedirs(folder, exist_ok=True)
    for name in os.listdir(given):
        if name != "files.parquet":
            os.symlink(os.path.join(given, name), os.path.join(folder, name))
    n = F.length("content")
    more = F.concat("content", F.lit("\n"), F.array(*map(F.lit, SNIPPETS))[n % len(SNIPPETS)], F.array(*map(F.lit, MAINS))[n % len(MAINS)])
    spark.read.parquet(f"{given}/files.parquet").withColumn("content", more).coalesce(1).write.parquet(f"{folder}/files.parquet")
    return folder
