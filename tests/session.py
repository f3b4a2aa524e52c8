import os

from seriesloom.session import build_session


def local_session():
    return build_session(
        "seriesloom-tests", f"local[{os.environ.get('TEST_CPUS', '8')}]", spark__sql__shuffle__partitions=8, spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
