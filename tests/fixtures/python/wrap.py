import hashlib
from Crypto.PublicKey import RSA
from Crypto.Cipher import AES as Block

BITS = 1024


def make_key(bits):
    return RSA.generate(bits)


def make_key_bytes(size):
    return make_key(size * 8)


def main():
    make_key_bytes(128)
    RSA.generate(BITS)
    n = 2048
    RSA.generate(n)
    key = b"0123456789abcdef"
    Block.new(key, Block.MODE_ECB)
    hashlib.md5(b"x")
